"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, prepare, saved


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> node long, root long: the smallest node that each linked node reaches.

    Every step is an aggregation and a join on the node, so a node with very many links is combined before
    the shuffle and its join is split; the number of steps grows with the logarithm of a component's size.
    Each step's links are saved in the shared folder. Loops and repeated links are allowed."""
    prepare(links.sparkSession)
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = saved(links.where("a <> b").select(high, low).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m"))).distinct())
        after = saved(small, "links")
        now = _state(after)
        forget(edges)
        edges = after
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        state = now


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    return tuple(r)
