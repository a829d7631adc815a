"""Mergeable quantile sketches by day.

One KLL sketch for each day and feature is made where the events are read, and
kept with the day's exact count, least and largest value. A window of days, or a
new reference, merges sketches; events are not read again. A late or corrected
day replaces its own partition. Ranks are right to within RANK_ERROR of the
count, whatever was merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 400  # of a sketch: some kB a day and feature
RANK_ERROR = 0.01  # for SIZE, with confidence 0.99


def daily_sketches(events: DataFrame, ts: str, features, size: int = SIZE) -> DataFrame:
    """events -> day, feature, n, least, largest, sketch. NULL and NaN don't count; a day without values of a feature has no row for it,
    nor has a NULL time."""
    def one(f):
        v = F.col(f).cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v), v)

    per = events.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(
        *[x for k, f in enumerate(features) for x in (F.count(one(f)).alias(f"n{k}"), F.min(one(f)).alias(f"lo{k}"), F.max(one(f)).alias(f"hi{k}"),
                                                      F.kll_sketch_agg_double(one(f), size).alias(f"s{k}"))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{k}").alias("n"), F.col(f"lo{k}").alias("least"), F.col(f"hi{k}").alias("largest"), F.col(f"s{k}").alias("sketch"))
                     for k, f in enumerate(features)])
    return per.select("day", F.explode(rows).alias("r")).select("day", "r.*").where("n > 0")


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Write days; days that are there already are replaced, others stay."""
    (sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_sketches(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored days from `first` to `last`; other days' files are not opened."""
    df = spark.read.parquet(path)
    bounds = [F.col("day") >= F.lit(first).cast("date")] * bool(first) + [F.col("day") <= F.lit(last).cast("date")] * bool(last)
    return df.where(reduce(lambda a, b: a & b, bounds)) if bounds else df


def merged(sketches: DataFrame, keys=("feature",), probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Days' rows -> keys, n, least, largest and a quantile q<percent> for each of `probs`."""
    g = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return g.select(*keys, "n", "least", "largest", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{round(100 * p)}") for p in probs])


def windows(sketches: DataFrame, days: int = 30, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """For each window of `days` days (one begins every day that any window with data can begin): window_start, feature, n, least,
    largest, quantiles. A day's row goes to `days` windows."""
    into = sketches.withColumn("window_start", F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))))
    return merged(into, ("window_start", "feature"), probs)


def sketch_psi(reference: DataFrame, current: DataFrame, bins: int = 10, grid: int = 1000, floor: float = 1e-6) -> DataFrame:
    """Stability of each feature between two sets of days, from sketches alone: feature, psi over the reference's quantile bins. Shares
    are counted over `grid` quantiles of either side, so they are right to 1 / grid more than the rank error."""
    points = F.array(*[F.lit((k + 0.5) / grid) for k in range(grid)])
    side = lambda df, name: df.groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("s")).select(
        "feature", F.kll_sketch_get_quantile_double("s", points).alias(name), *[F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("cuts")] * (name == "ref"))
    j = side(reference, "ref").join(side(current, "cur"), "feature").withColumn("cuts", F.array_distinct("cuts"))
    upto = lambda c: F.concat(F.array(F.lit(0.0)), F.transform("cuts", lambda cut: F.size(F.filter(c, lambda v: v <= cut)) / grid), F.array(F.lit(1.0)))
    share = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.greatest(F.get(x, i) - F.get(x, i - 1), F.lit(floor)))
    j = j.select("feature", upto("ref").alias("r"), upto("cur").alias("c"))
    return j.select("feature", F.aggregate(F.zip_with(share(F.col("r")), share(F.col("c")), lambda p, q: (q - p) * F.log(q / p)), F.lit(0.0), lambda acc, x: acc + x).alias("psi"))
