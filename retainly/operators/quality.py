"""Validation and data-quality reports as long tables.

Every per-column statistic of a report comes out of ONE aggregate over the
input (null counts, ranges, variances), then `unpivot` turns the single wide
row into (check, column_name, measure, value) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import column_splits, exact_quantiles, unpivot


def _long(row: DataFrame, specs) -> DataFrame:
    """specs: list of (check, column_name, measure, column-in-row). One
    `unpivot` of the single wide row, labels looked up in a literal map."""
    srcs = [src for _, _, _, src in specs]
    wide = row.select(*[F.col(src).cast("double").alias(f"m{i}") for i, src in enumerate(srcs)])
    long = wide.unpivot([], [f"m{i}" for i in range(len(srcs))], "_k", "value")
    labels = F.create_map(*[x for i, (c, n, m, _) in enumerate(specs)
                            for x in (F.lit(f"m{i}"), F.struct(F.lit(c).alias("check"), F.lit(n).alias("column_name"),
                                                               F.lit(m).alias("measure")))])
    lab = F.element_at(labels, F.col("_k"))
    return long.select(lab["check"].alias("check"), lab["column_name"].alias("column_name"),
                       lab["measure"].alias("measure"), F.col("value"))


def _rows(row: DataFrame, rows) -> DataFrame:
    """One output row per tuple of aliased columns over a 1-row frame: an
    exploded array of structs, so the aggregate below runs once."""
    return row.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("_r")).select("_r.*")


def _row_digest(cols) -> list:
    """128 bits of a whole row in place of its columns, so that counting equal
    rows shuffles 16 bytes a row. Which columns are NULL is part of both."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(nulls, *cols).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(cols), nulls).alias("_h2")]


def integrity_report(df: DataFrame, required=()) -> DataFrame:
    """Rows, columns, null count / % per column, the
    column type with its count of typed (non-null) values, duplicate rows
    count / %, min / max of timestamp columns (epoch seconds), and presence
    of required columns. Output: check, column_name, measure, value."""
    cols = df.columns
    types = dict(column_types(df))
    ts_cols = [c for c, t in df.dtypes if t.startswith("timestamp") or t == "date"]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        if c in ts_cols:
            aggs += [F.unix_timestamp(F.min(c).cast("timestamp")).alias(f"_min_{i}"),
                     F.unix_timestamp(F.max(c).cast("timestamp")).alias(f"_max_{i}")]
    base = df.agg(*aggs)
    dups = df.select(*_row_digest(cols)).groupBy("_h1", "_h2").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("_dups"))
    row = base.crossJoin(dups).withColumn("_ncols", F.lit(len(cols)))
    for i, _ in enumerate(cols):
        row = row.withColumn(f"_pct_{i}", F.round(F.try_divide(F.col(f"_null_{i}"), F.col("_rows")) * 100, 6))
    row = row.withColumn("_dpct", F.round(F.try_divide(F.col("_dups"), F.col("_rows")) * 100, 6))
    specs = [("table", "*", "rows", "_rows"), ("table", "*", "columns", "_ncols"),
             ("duplicates", "*", "count", "_dups"), ("duplicates", "*", "pct", "_dpct")]
    for i, c in enumerate(cols):
        specs += [("nulls", c, "count", f"_null_{i}"), ("nulls", c, "pct", f"_pct_{i}")]
        row = row.withColumn(f"_typed_{i}", F.col("_rows") - F.col(f"_null_{i}"))
        specs.append(("types", c, types[c], f"_typed_{i}"))
        if c in ts_cols:
            specs += [("date_range", c, "min", f"_min_{i}"), ("date_range", c, "max", f"_max_{i}")]
    for r in required:
        row = row.withColumn(f"_req_{r}", F.lit(1 if r in cols else 0))
        specs.append(("schema", r, "present", f"_req_{r}"))
    return _long(row, specs)


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) from the schema (metadata, no job)."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def range_assertions(df: DataFrame, rules) -> DataFrame:
    """rules = [(column, lo, hi)] -> column_name, lo, hi, out_of_range, passed.
    All rules in one aggregate."""
    aggs = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"_o{i}") for i, (c, lo, hi) in enumerate(rules)]
    return _rows(df.agg(*aggs), [
        (F.lit(c).alias("column_name"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
         F.col(f"_o{i}").cast("bigint").alias("out_of_range"), (F.col(f"_o{i}") == 0).cast("bigint").alias("passed"))
        for i, (c, lo, hi) in enumerate(rules)])


def quality_gates(df: DataFrame, cols, max_null_share: float = 0.05) -> DataFrame:
    """Per column null share, min and max, and gate flags (null share
    > 5 %, constant column; an empty input has no share and no constant but
    fails the constant gate). "Variance = 0" is tested exactly as min = max
    (a floating variance of large values is never exactly reproducible)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"_z{i}"), F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}")]
    share = [F.try_divide(F.col(f"_z{i}"), F.col("_n")) for i, _ in enumerate(cols)]
    return _rows(df.agg(*aggs), [
        (F.lit(c).alias("column_name"), F.round(share[i], 6).alias("null_share"),
         F.col(f"_lo{i}").cast("double").alias("min"), F.col(f"_hi{i}").cast("double").alias("max"),
         F.coalesce((share[i] > max_null_share).cast("bigint"), F.lit(0)).alias("null_gate_failed"),
         F.coalesce((F.col(f"_lo{i}") == F.col(f"_hi{i}")).cast("bigint"), F.lit(1)).alias("constant_gate_failed"))
        for i, c in enumerate(cols)])


# Feature caps of the data-quality notes.
FEATURE_CAPS = {"days_since_last_purchase": 15000, "total_spend": 100000, "support_tickets": 1000}


def apply_caps(df: DataFrame, caps: dict) -> DataFrame:
    """least(column, cap) for each capped column (NULL stays NULL)."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(caps[c]))).cast(t).alias(c)
                       if c in caps else F.col(c)
                       for c, t in df.dtypes])


# Scoring-input rules (feature, min, max, missing value or 'median').
SCORING_RULES = [
    ("purchase_count_30d", 0, 1000, 0),
    ("total_spend_30d", 0, 100000, 0),
    ("days_since_last_purchase", 0, 3650, 365),
    ("rfm_score", 0, 100, "median"),
    ("support_ticket_count_90d", 0, 1000, 0),
    ("product_category_diversity", 0, 100, "median"),
]


def validate_scoring_input(df: DataFrame, rules=SCORING_RULES, key: str = "customer_id"):
    """Fill missing values by rule (median rules use the exact
    median of the input), then split rows into (valid, rejected); a rejected
    row lists the features out of range in `reject_reason`."""
    med_cols = [c for c, _, _, m in rules if m == "median"]
    filled = df
    if med_cols:
        long = unpivot(df, [], med_cols)
        meds = exact_quantiles(long, "value", [0.5], keys=["feature"],
                               splits=column_splits(df, med_cols), small_keys=True)
        wide = meds.groupBy().pivot("feature", med_cols).agg(F.first("q_0"))
        filled = df.crossJoin(F.broadcast(wide.select(*[F.col(c).alias(f"_med_{c}") for c in med_cols])))
    out = []
    for c, _, _, m in rules:
        fill = F.col(f"_med_{c}") if m == "median" else F.lit(m)
        out.append(F.coalesce(F.col(c).cast("double"), fill.cast("double")).alias(c))
    filled = filled.select(key, *out)
    bad = [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(c)) for c, lo, hi, _ in rules]
    tagged = filled.withColumn("reject_reason", F.concat_ws(",", *bad))
    valid = tagged.filter(F.col("reject_reason") == "").drop("reject_reason")
    rejected = tagged.filter(F.col("reject_reason") != "")
    return valid, rejected


def zscore_outlier_flag(df: DataFrame, cols, threshold: float = 3.0) -> DataFrame:
    """is_outlier = 1 when any column has abs(z) > threshold, z with the
    population std of the column; zero-std columns never flag; NULLs skipped."""
    stats = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    z = [F.when(F.col(f"_s{i}") > 0, F.abs(F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}") > threshold)
         for i, c in enumerate(cols)]
    anyz = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), [F.coalesce(x, F.lit(False)) for x in z])
    return df.crossJoin(F.broadcast(stats)).select(*df.columns, anyz.cast("bigint").alias("is_outlier"))


def feature_statistics(df: DataFrame, cols, n_buckets: int | None = None) -> DataFrame:
    """Per column count, nulls, mean, sample std, min, exact quartiles,
    max. Quartiles for all columns come from one keyed ordered pass. Cut
    points, aggregates and that pass read the saved columns, so whatever makes
    df is computed once."""
    df = materialize(df.select(*cols))
    long = unpivot(df, [], cols)
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], keys=["feature"],
                         splits=column_splits(df, cols, n_buckets), small_keys=True)
    j = basic.join(qs, "feature", "left")
    return j.select(F.col("feature").alias("column_name"), F.col("count").cast("bigint").alias("count"),
                    F.col("nulls").cast("bigint").alias("nulls"),
                    F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                    F.round("min", 6).alias("min"), F.round("q_0", 6).alias("q25"),
                    F.round("q_1", 6).alias("q50"), F.round("q_2", 6).alias("q75"),
                    F.round("max", 6).alias("max"))
