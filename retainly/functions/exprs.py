"""Small built-in expression helpers (JVM-side, codegen-friendly; no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_SCALE = 6  # ratios are reported rounded to 6 places (oracle rule)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_long(c) -> Column:
    return col(c).cast("bigint")


def as_double(c, scale: int | None = RATIO_SCALE) -> Column:
    x = col(c).cast("double")
    return F.round(x, scale) if scale is not None else x


def days_between(later, earlier) -> Column:
    """Whole calendar days; equals the timedelta-floor for midnight values."""
    return F.datediff(F.to_date(col(later)), F.to_date(col(earlier)))


def not_nan(c) -> Column:
    """A numeric value with NaN as NULL (NaN -> NULL is the read rule)."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def since(as_of, days: int) -> Column:
    """Timestamp literal `as_of - days` (window lower bound, inclusive)."""
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")


def code_map(c, mapping: dict, default=None) -> Column:
    """Categorical code lookup as a `CASE` chain; unknown values -> default (NULL)."""
    out = None
    for k, v in mapping.items():
        out = F.when(col(c) == k, F.lit(v)) if out is None else out.when(col(c) == k, F.lit(v))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def flag(cond: Column) -> Column:
    """Boolean condition as a 0/1 integer, NULL -> 0."""
    return F.coalesce(cond.cast("int"), F.lit(0)).cast("bigint")


def clip(c, lo=None, hi=None) -> Column:
    x = col(c)
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


TWO_PI = 2 * math.pi
