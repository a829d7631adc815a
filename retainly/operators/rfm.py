"""RFM scores (quintile buckets) and percent-rank RFM index.

Quintile edges are exact linear quantiles (distributed, `exact_quantiles`),
a 1-row table joined by broadcast; buckets are right-closed with the lowest
value included, and tied edges never raise (the smallest bucket whose edge
is >= the value wins). The frequency score buckets the first-come rank
(`rank_first`, ties by customer_id) — no global single-task window anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long, days_between
from ..session import materialize
from .ordered import column_splits, exact_quantiles, rank_first, unpivot, value_ranks

QUINTILES = (0.2, 0.4, 0.6, 0.8)


def rfm_raw(tx: DataFrame, as_of: str) -> DataFrame:
    """recency days, frequency, monetary per customer with transactions."""
    return tx.groupBy("customer_id").agg(
        days_between(F.lit(as_of).cast("timestamp_ntz"), F.max("order_date")).alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("order_amount").cast("double").alias("monetary"))


def quintile_bucket(col: str, edges_prefix: str):
    """1 + number of inner edges strictly below the value (1..5)."""
    return 1 + sum((F.col(col) > F.col(f"{edges_prefix}{i}")).cast("int") for i in range(4))


def rfm_scores(tx: DataFrame, as_of: str) -> DataFrame:
    """recency/frequency/monetary with r (reversed), f and m quintile
    scores and rfm_score = 100 r + 10 f + m."""
    # one row per customer, read by five ordered passes: computed once and
    # checkpointed to shared storage instead of re-aggregating the orders
    return rfm_from_raw(materialize(rfm_raw(tx, as_of)))


def rfm_from_raw(raw: DataFrame) -> DataFrame:
    """rfm_scores over a per-customer (customer_id, recency, frequency,
    monetary) table that is already materialized (it is read several times)."""
    # cut points of every ordered pass in ONE approxQuantile pass
    sp = column_splits(raw, ["recency", "monetary", "frequency", "customer_id"])
    q = exact_quantiles(unpivot(raw, [], ["recency", "monetary"]), "value", QUINTILES, ["feature"],
                        splits={"recency": sp["recency"], "monetary": sp["monetary"]}, small_keys=True)
    er = q.filter(F.col("feature") == "recency").select(*[F.col(f"q_{i}").alias(f"_er{i}") for i in range(4)])
    em = q.filter(F.col("feature") == "monetary").select(*[F.col(f"q_{i}").alias(f"_em{i}") for i in range(4)])
    ranked = rank_first(raw, "frequency", "customer_id", value_splits=sp["frequency"],
                        tie_splits=sp["customer_id"])
    n1 = F.col("_n") - 1
    # ceil(5 (r - 1) / (n - 1)) in integer arithmetic, at least 1
    f_score = F.when(n1 <= 0, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.floor((5 * (F.col("_rank") - 1) + n1 - 1) / n1)))
    j = ranked.crossJoin(F.broadcast(er)).crossJoin(F.broadcast(em))
    r = 6 - quintile_bucket("recency", "_er")
    m = quintile_bucket("monetary", "_em")
    return j.select(as_long("customer_id").alias("customer_id"), as_long("recency").alias("recency"),
                    as_long("frequency").alias("frequency"), as_double("monetary").alias("monetary"),
                    as_long(r).alias("r_score"), as_long(f_score).alias("f_score"), as_long(m).alias("m_score"),
                    as_long(r * 100 + f_score * 10 + m).alias("rfm_score"))


def percent_rank_col(df: DataFrame, value: str, out: str, key: str = "customer_id") -> DataFrame:
    """SQL percent_rank of `value` over all rows of df: (rank - 1) / (n - 1),
    ties share the lowest rank; n = 1 gives 0. Distributed (ordered prefix)."""
    r = value_ranks(df.select(key, value), value)
    pr = F.when(F.col("_n") > 1, F.col("_below") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return df.join(r.select(value, pr.alias(out)), value, "left")
