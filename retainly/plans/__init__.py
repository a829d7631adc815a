"""Registered queries, one module per operator family."""

from . import account, catalog, cleaning, features, modeling, monitoring, sinks, streaming  # noqa: F401
from .registry import REGISTRY, Query  # noqa: F401
