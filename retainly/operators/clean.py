"""Cleaning: dedup, missing values, outliers, ETL customer/transaction cleaning.

Global statistics (means, quartiles, std) are 1-row aggregates joined back by
broadcast: one extra scan, no driver round trip, no per-column job. Dedup
survivors are chosen by aggregation (`min` of a struct), which aggregates
partially map-side, so a hot duplicate key never lands whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import not_nan
from ..session import materialize
from .ordered import exact_quantiles, forward_fill


def missing_columns(df: DataFrame, required) -> list[str]:
    """V1: required columns absent from the schema (schema metadata only)."""
    present = set(df.columns)
    return [c for c in required if c not in present]


def validate_schema(df: DataFrame, required) -> bool:
    return not missing_columns(df, required)


def drop_duplicates(df: DataFrame, subset=None, order=None) -> DataFrame:
    """V2: all-column dedup, or dedup on `subset` keeping the row that is
    smallest by `order` (default: the remaining columns), deterministically."""
    if not subset:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in subset]
    order = list(order) if order else rest
    rest = order + [c for c in rest if c not in order]
    g = df.groupBy(*subset).agg(F.min(F.struct(*rest)).alias("_keep"))
    return g.select(*subset, *[F.col(f"_keep.{c}").alias(c) for c in rest]).select(*df.columns)


def fill_drop(df: DataFrame, cols) -> DataFrame:
    """V3a."""
    return df.dropna(subset=list(cols))


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """V3c."""
    return df.fillna(0, subset=list(cols))


def _fill_from_stats(df: DataFrame, cols, stats: DataFrame) -> DataFrame:
    j = df.crossJoin(F.broadcast(stats))
    types = dict(df.dtypes)
    own = {c: F.nanvl(c, F.lit(None)) if types[c] in ("double", "float") else F.col(c) for c in cols}
    return j.select(*[F.coalesce(own[c], F.col(f"_s_{c}")).cast(types[c]).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def fill_mean(df: DataFrame, cols) -> DataFrame:
    """All column means in ONE aggregate, broadcast back (1 row)."""
    stats = df.agg(*[F.avg(not_nan(c)).alias(f"_s_{c}") for c in cols])
    return _fill_from_stats(df, cols, stats)


def fill_median(df: DataFrame, cols) -> DataFrame:
    """V3e: exact linear median per column (distributed order statistics)."""
    meds = [exact_quantiles(df, c, [0.5]).select(F.col("q_0").alias(f"_s_{c}")) for c in cols]
    stats = reduce(lambda a, b: a.crossJoin(b), meds)
    return _fill_from_stats(df, cols, stats)


def fill_max(df: DataFrame, cols) -> DataFrame:
    """V3f (max rule)."""
    types = dict(df.dtypes)
    number = {c: F.nanvl(c, F.lit(None)) if types[c] in ("double", "float") else F.col(c) for c in cols}
    stats = df.agg(*[F.max(number[c]).alias(f"_s_{c}") for c in cols])
    return _fill_from_stats(df, cols, stats)


def fill_mode(df: DataFrame, cols) -> DataFrame:
    """V3f (mode rule): most frequent non-null value, ties -> smallest value.
    Counting per (value) aggregates map-side; the winner is a 1-row max_by."""
    stats = None
    for c in cols:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        best = counts.agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c))).alias(f"_s_{c}"))
        stats = best if stats is None else stats.crossJoin(best)
    return _fill_from_stats(df, cols, stats)


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    """V3f (constant rule)."""
    return df.fillna(values)


def fill_by_family(df: DataFrame, rules: dict) -> DataFrame:
    """V3f: a rule for each column: a number is an exact percentile (50: the
    median), "mode" and "max" are those of the column, ("constant", v) is v."""
    for rule, fill in (("mode", fill_mode), ("max", fill_max)):
        cols = [c for c, r in rules.items() if r == rule]
        df = fill(df, cols) if cols else df
    constants = {c: r[1] for c, r in rules.items() if isinstance(r, tuple)}
    df = fill_constant(df, constants) if constants else df
    for c, p in rules.items():
        if isinstance(p, (int, float)):
            known = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_v"))
            q = exact_quantiles(known, "_v", [p / 100]).select(F.col("q_0").alias("_q"))  # one row
            df = df.crossJoin(F.broadcast(q)).withColumn(c, F.coalesce(F.col(c).cast("double"), F.col("_q"))).drop("_q")
    return df


def fill_forward(df: DataFrame, cols, key: str, order) -> DataFrame:
    """V3d: forward fill per key in time order (key and order are required:
    an unordered global fill has no defined result and runs in one task)."""
    return forward_fill(df, list(cols), key, order)


def remove_outliers_iqr(df: DataFrame, col: str, rel_error: float = 0.05, k: float = 1.5) -> DataFrame:
    """V4: approximate quartiles (one 1-row aggregate), inclusive 1.5 IQR fences."""
    acc = max(1, int(round(1.0 / rel_error)))
    q = df.agg(F.percentile_approx(col, F.array(F.lit(0.25), F.lit(0.75)), acc).alias("_q"))
    fences = q.select((F.col("_q")[0] - k * (F.col("_q")[1] - F.col("_q")[0])).alias("_lo"),
                      (F.col("_q")[1] + k * (F.col("_q")[1] - F.col("_q")[0])).alias("_hi"))
    return (df.crossJoin(F.broadcast(fences))
            .filter((F.col(col) >= F.col("_lo")) & (F.col(col) <= F.col("_hi")))
            .drop("_lo", "_hi"))


def remove_outliers_exact_iqr(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """IQR filter with exact linear quartiles (as in the pandas cleaner)."""
    q = exact_quantiles(df, col, [0.25, 0.75])
    fences = q.select((F.col("q_0") - k * (F.col("q_1") - F.col("q_0"))).alias("_lo"),
                      (F.col("q_1") + k * (F.col("q_1") - F.col("q_0"))).alias("_hi"))
    return (df.crossJoin(F.broadcast(fences))
            .filter((F.col(col) >= F.col("_lo")) & (F.col(col) <= F.col("_hi")))
            .drop("_lo", "_hi"))


def remove_outliers_zscore(df: DataFrame, col: str, threshold: float = 3.0) -> DataFrame:
    """V5: keep abs(x - mean) / sample std <= threshold; a constant column has
    no outliers, NULL and NaN are dropped."""
    s = df.agg(F.avg(not_nan(col)).alias("_m"), F.stddev_samp(not_nan(col)).alias("_sd"))
    z = F.when(F.col("_sd") > 0, F.abs(not_nan(col) - F.col("_m")) / F.col("_sd")) \
        .when(not_nan(col).isNotNull(), F.lit(0.0))
    return (df.crossJoin(F.broadcast(s))
            .filter(z <= threshold)
            .drop("_m", "_sd"))


def clean_customers(df: DataFrame) -> DataFrame:
    """V6: dedup on customer_id -> median-fill account_age_days -> zero-fill
    lifetime_value -> exact IQR filter on lifetime_value."""
    d = materialize(drop_duplicates(df, ["customer_id"]))  # read by two ordered passes
    d = fill_median(d, ["account_age_days"])
    d = fill_zero(d, ["lifetime_value"])
    return remove_outliers_exact_iqr(d, "lifetime_value")


def clean_transactions(df: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """V7-V9: amount > 0, then exact (customer, amount, timestamp) duplicates
    removed keeping the first by transaction id."""
    pos = df.filter(F.col("amount") > 0)
    return drop_duplicates(pos, ["customer_id", "amount", "transaction_date"], order=[id_col])


def drop_near_duplicates(df: DataFrame, seconds: int = 60, id_col: str = "transaction_id") -> DataFrame:
    """Drop a transaction when the previous one of the same customer and
    amount (by time, then id) is at most `seconds` earlier. The previous
    timestamp is a chunked lag, so one hot (customer, amount) pair is split
    across tasks."""
    prev = forward_fill(df, ["transaction_date"], ["customer_id", "amount"],
                        ["transaction_date", id_col], include_current=False)
    gap = F.unix_timestamp(F.col("transaction_date").cast("timestamp")) - \
        F.unix_timestamp(F.col("prev_transaction_date").cast("timestamp"))
    return prev.filter(F.col("prev_transaction_date").isNull() | (gap > seconds)) \
        .drop("prev_transaction_date")
