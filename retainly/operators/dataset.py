"""Feature-table assembly, scaling, encoding, splits, class weights (J1-J4,
F31-F33, T1-T5).

Joins are all on customer_id, so Spark shuffles each side once on that key
and the join chain reuses the partitioning. Scaling parameters are one
1-row aggregate broadcast back. Splits are a pure function of
(customer id, seed): deterministic on re-execution, no shuffle, no sampling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from .ordered import exact_quantiles


def numeric_columns(df: DataFrame, exclude=("customer_id",)) -> list[str]:
    num = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if c not in exclude and (t in num or t.startswith("decimal"))]


def left_join_all(base: DataFrame, others, key: str = "customer_id", fill=0) -> DataFrame:
    """Base left-joined with each frame on `key`, numeric NULLs -> fill."""
    j = reduce(lambda a, b: a.join(b, key, "left"), others, base)
    return j.fillna(fill, subset=numeric_columns(j, (key,)))


def combine_features(frames, key: str = "customer_id", fill=0) -> DataFrame:
    """Full outer join of N feature sets on `key`, fill 0."""
    j = reduce(lambda a, b: a.join(b, key, "full"), frames)
    return j.fillna(fill, subset=numeric_columns(j, (key,)))


def scaling_params(df: DataFrame, cols) -> DataFrame:
    """F31 / T3 fit: mean and population std of every column (1 row)."""
    return df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])


def standard_scale(df: DataFrame, cols, params: DataFrame | None = None) -> DataFrame:
    """F31 / T3 transform: (x - mean) / std with parameters fitted on `params`
    (default: on df itself); zero std -> 0."""
    p = params if params is not None else scaling_params(df, cols)
    j = df.crossJoin(F.broadcast(p))
    return j.select(*[F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
                      .otherwise(F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def minmax_scale(df: DataFrame, cols) -> DataFrame:
    """F32: (x - min) / (max - min); constant columns -> 0."""
    p = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(p))
    rng = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    return j.select(*[F.when(rng(c) > 0, (F.col(c) - F.col(f"_lo_{c}")) / rng(c)).otherwise(F.lit(0.0)).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, col: str, domain, prefix: str | None = None) -> DataFrame:
    """fixed-domain indicator columns `<prefix>_<value>` (0/1)."""
    prefix = prefix or col
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("bigint").alias(f"{prefix}_{v}") for v in domain])


def hash_unit(key, seed: int):
    """Uniform [0, 1) from md5(key || '-' || seed): the first 32 bits."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / 4294967296.0


def stratified_split(df: DataFrame, key: str, label: str, val: float = 0.15, test: float = 0.15,
                     seed: int = 42) -> DataFrame:
    """Train / validation / test by a per-row hash, cut at the hash's exact
    quantiles within each class, so every class is split in the same
    proportions, to the row. The cuts are one row per class."""
    u = df.select("*", hash_unit(key, seed).alias("_u"))
    cuts = exact_quantiles(u, "_u", [1 - val - test, 1 - test], keys=[label]) \
        .select(F.col(label).alias("_class"), F.col("q_0").alias("_c1"), F.col("q_1").alias("_c2"))
    j = u.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_class")))
    split = F.when(F.col("_u") <= F.col("_c1"), "train").when(F.col("_u") <= F.col("_c2"), "validation").otherwise("test")
    return j.withColumn("split", split).drop("_u", "_class", "_c1", "_c2")


def temporal_split(df: DataFrame, date_col: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Train on the past, test on the future: exact date quantile cuts."""
    d = df.withColumn("_day", F.datediff(F.to_date(date_col), F.lit("1970-01-01").cast("date")))
    q = exact_quantiles(d, "_day", [train, train + val]).select(F.col("q_0").alias("_c1"), F.col("q_1").alias("_c2"))
    j = d.crossJoin(F.broadcast(q))
    split = F.when(F.col("_day") <= F.col("_c1"), "train").when(F.col("_day") <= F.col("_c2"), "validation") \
        .otherwise("test")
    return j.withColumn("split", split).drop("_day", "_c1", "_c2")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """T4: per class count, balanced weight n / (2 n_c) and the positive-class
    weight neg / pos (as in scale_pos_weight)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = g.agg(F.sum("n_c").alias("n"), F.sum(F.when(F.col(label) == 1, F.col("n_c"))).alias("pos"),
                F.sum(F.when(F.col(label) != 1, F.col("n_c"))).alias("neg"))
    j = g.crossJoin(F.broadcast(tot))
    return j.select(as_long(label).alias(label), as_long("n_c").alias("count"),
                    as_double(F.col("n") / (2 * F.col("n_c"))).alias("balanced_weight"),
                    as_double(F.col("neg") / F.col("pos")).alias("scale_pos_weight"))


def with_weights(df: DataFrame, label: str, out: str = "weight", fit: DataFrame | None = None) -> DataFrame:
    """Balanced sample weights as a column (for `weightCol`), from the class
    counts of `fit` (the training rows; default: df). `label` is a class label:
    one row per class is broadcast. A class that `fit` lacks weighs 1."""
    w = class_weights(df if fit is None else fit, label).select(label, F.col("balanced_weight").alias(out))
    return df.join(F.broadcast(w), label, "left").fillna(1.0, subset=[out])


def oversample(df: DataFrame, label: str, copies: int) -> DataFrame:
    """T5: positives replicated `copies` times (explode of a fixed sequence);
    negatives kept once. Synthetic neighbour points are not generated."""
    n = F.when(F.col(label) == 1, F.lit(copies)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
