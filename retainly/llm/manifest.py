"""Merkle manifest of a dataset, by slot pivots.

Each row is a leaf: the SHA-256 of its fields. The leaves of a group stand in
order; runs of FANOUT consecutive nodes are hashed into their parents, run by
run, until one node is left, the group's root; the groups' roots, in order of
the group, are leaves of the tree above. A conditional aggregate for each slot
spreads a parent's children into FANOUT columns: the columns one after another
make the parent's hash, and without a child's own column its siblings. A proof
is a list of (left, right) siblings from the leaf to the root; folding it over
a leaf recomputes the root.

Order comes from one range partitioning with sorted partitions: a node's place
is its place within its partition plus the count of its group before that
partition, so no window holds a group and a group with most of the rows spreads
over all partitions. A parent has at most FANOUT children. Proofs go down from
the roots: each parent's row hands its children their siblings, so leaves are
never joined to anything.

All in DataFrame functions. Null fields have a mark of their own. Rows that
share a doc_id stand by their hash; equal rows are leaves of their own, and the
partitioning tells them apart. Null ids stand first, as does a null group. A
manifest of no rows has no rows and no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, saved

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIDES = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 in lowercase hex of the fields, each as its UTF-8 bytes' number, a colon and its text, or - if null."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)).cast("binary"), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, ..., the columns of `order`) -> the same with at, each row's place within its group by `order`, and n, the
    group's number of rows, and part, the partition it was sorted in; saved. Equal rows have places of their own."""
    spread = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = spread.repartitionByRange(partitions(rows.sparkSession), "grp", *order, "tie").sortWithinPartitions("grp", *order, "tie")
    # Row numbers within partitions; after saving, part and line are as fixed as any column.
    line = F.monotonically_increasing_id()
    kept = saved(dealt.drop("tie").withColumns({"part": F.shiftright(line, 33), "line": line.bitwiseAND(F.lit(2**33 - 1))}), "manifest-order")
    # One row for each partition and group; as groups stand in order, partitions and groups together at most.
    counts = kept.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("line").alias("first"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("grp").alias("of"), F.col("part").alias("in"), (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                            F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    joined = kept.join(offsets, F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return joined.withColumn("at", F.col("line") + F.col("shift")).drop("of", "in", "line", "shift")


def pivot(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """Nodes (grp, at, n, hash, extra...) -> their parents (grp, at, n, s0.. structs of the children in their slots, hash)."""
    child = F.struct("hash", *extra)
    slots = [F.max(F.when(F.col("at") % FANOUT == k, child)).alias(f"s{k}") for k in range(FANOUT)]
    wide = nodes.groupBy("grp", F.floor(F.col("at") / FANOUT).alias("at"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(*slots)
    return wide.withColumn("hash", F.sha2(F.concat(*(F.coalesce(f"s{k}.hash", F.lit("")) for k in range(FANOUT))).cast("binary"), 256))


def grow(nodes: DataFrame, extra: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Placed nodes (grp, at, n, hash, extra...) -> the levels of parents, saved, and the groups' roots (grp, hash)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots, over = [], [nodes.where("n = 1").select("grp", "hash")], nodes.where("n > 1")
    while most > 1:
        parents = saved(pivot(over, extra), f"manifest-level-{len(levels) + 1}")
        levels.append(parents)
        roots.append(parents.where("n = 1").select("grp", "hash"))
        over, extra, most = parents.where("n > 1"), [], -(-most // FANOUT)
    return levels, reduce(DataFrame.unionByName, roots)


def descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, extra: list[str]) -> DataFrame:
    """What grow() was given and made, and tops (of, path, more...: one row a group) -> hash, extra..., path, more...: each node
    with its siblings level by level, those of its group's root after its own."""
    more = [c for c in tops.columns if c not in ("of", "path")]
    own = lambda rows: rows.join(tops, F.col("grp").eqNullSafe(F.col("of"))).drop("of")  # noqa: E731  rows that are roots of groups
    below = None
    for k, level in reversed(list(enumerate(levels))):
        known = own(level.where("n = 1"))
        if below is not None:
            up = below.select(F.col("grp").alias("of"), F.col("at").alias("place"), "path", *more)
            known = known.unionByName(level.where("n > 1").join(up, F.col("grp").eqNullSafe(F.col("of")) & (F.col("at") == F.col("place"))).drop("of", "place"))
        joined = lambda a, b: F.concat(F.lit(""), *(F.coalesce(f"s{i}.hash", F.lit("")) for i in range(a, b)))
        children = [F.when(F.col(f"s{i}").isNotNull(), F.struct(
            (F.col("at") * FANOUT + i).alias("at"), F.col(f"s{i}").alias("child"),
            F.struct(joined(0, i).alias("left"), joined(i + 1, FANOUT).alias("right")).alias("sides"))) for i in range(FANOUT)]
        each = known.select("grp", "path", *more, F.explode(F.filter(F.array(*children), lambda c: c.isNotNull())).alias("c"))
        below = each.select("grp", F.col("c.at").alias("at"), "c.child.*", F.concat(F.array("c.sides"), "path").alias("path"), *more)
    alone = own(nodes.where("n = 1")).select("hash", *extra, "path", *more)
    return alone if below is None else alone.unionByName(below.select("hash", *extra, "path", *more))


def fold(hash: Column, path: Column) -> Column:
    """The root that a leaf's hash and a path of siblings give."""
    return F.aggregate(path, hash, lambda h, side: F.sha2(F.concat(side["left"], h, side["right"]).cast("binary"), 256))


def proofs(leaves: DataFrame, order: list[str], extra: list[str]) -> DataFrame:
    """leaves (grp, hash, the columns of `order`, extra...) -> hash, extra..., subroot, root, path: each leaf with its group's root,
    the root of all, and its siblings (left, right), level by level from the leaf to the root. Equal in `order`: by hash."""
    spark = leaves.sparkSession
    prepare(spark)
    nodes = placed(leaves, [*order, "hash"])
    levels, roots = grow(nodes, extra)
    groups = placed(roots.select(F.lit(0).alias("grp"), F.col("grp").alias("group"), "hash"), ["group"])
    upper, root = grow(groups, ["group"])
    last = root.select(F.col("grp").alias("of"), F.col("hash").alias("root"), F.array().cast(SIDES).alias("path"))
    tops = descend(groups, upper, last, ["group"])
    tops = saved(tops.select(F.col("group").alias("of"), F.col("hash").alias("subroot"), "root", "path"), "manifest-groups")
    return descend(nodes, levels, tops, extra)
