"""Query registry: every registered query is (spark, sf_dir) -> DataFrame plus
its independent DuckDB oracle text (or None when no exact SQL form exists)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_defaults
from ..sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: tuple


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, oracle: str | None = None):
    """Decorator for `fn(t: Tables) -> DataFrame`; `ids` are SURVEY §2 ids."""

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_defaults(spark)
            return fn(Tables(spark, sf_dir))

        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, oracle, tuple(ids.split()))
        return fn

    return deco
