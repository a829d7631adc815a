"""Resharding by minimum-cost flow.

Given rows in old shards and a number of new ones, the new row counts are to
be at most one apart while as few bytes as possible move. Rows that stay in
their shard cost nothing; a moved row costs its bytes. That is a transport
problem over blocks of rows of an old shard: its network has one node per shard
and side, a hub between them and parallel arcs for the blocks, and is solved on
the driver by shortest augmenting paths. The rows that leave a shard are its
smallest ones, and the rows that the flow can choose of have their exact sizes
as costs, so the bytes moved are the fewest. What the driver holds is bounded by
shards x size classes (four to an octave) and the CUTS parts that a class is cut
into, not by rows.

Positions of rows come from counts per (old shard, moved or not, slice), where
a slice is a hash of the row; a shard with a third of all rows is ranked by
as many tasks as there are slices. Nothing is read from a text but its size
and checksum, and the texts themselves move only in rewrite().

Null texts have no bytes (size 8, checksum 0); null and repeated doc_ids are
rows like any other; old shards may be null (a shard of its own that has no
successor, so all its rows move). An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, saved

HEADER = 8  # bytes that a row takes besides its text
FINE = 2  # binary digits after the leading one that make a size's class
CUTS = 64  # parts that a class is cut into at a time


def size_class(size: Column) -> Column:
    """The size with all but its leading binary digits cleared."""
    drop = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - FINE, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("bigint")
    return F.floor(size / unit).cast("bigint") * unit


def solve(blocks: dict[int, list[tuple[int, int]]], shards: int) -> dict[tuple[int, int], int]:
    """Fewest bytes: rows to move by (old, new) shard.

    blocks: for each old shard the (bytes of a row, rows) of its blocks. New shards 0 to shards-1 take
    floor(rows / shards) each and, all together, the remaining rows, one each.
    """
    old = sorted(blocks)
    total = sum(n for rows in blocks.values() for _, n in rows)
    least, more = divmod(total, shards)
    # Nodes: (0, s) old shards, (1, s) new ones, "hub". An arc: [to, capacity, cost, its reverse].
    arcs: dict = defaultdict(list)

    def arc(a, b, capacity, cost):
        there, back = [b, capacity, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        arcs[a].append(there)
        arcs[b].append(back)
        return there

    moved_to = {}
    for s in old:
        rows = sum(n for _, n in blocks[s])
        arc("from", (0, s), rows, 0)
        if 0 <= s < shards:
            arc((0, s), (1, s), rows, 0)
        for cost, n in sorted(blocks[s]):
            arc((0, s), "hub", n, cost)
    for s in range(shards):
        moved_to[s] = arc("hub", (1, s), total, 0)
        arc((1, s), "to", least, 0)
        arc((1, s), "extra", 1, 0)
    arc("extra", "to", more, 0)

    potential: dict = defaultdict(int)
    left = total
    while left:
        dist, via, done, heap, order = {"from": 0}, {}, set(), [(0, 0, "from")], 0
        while heap:
            d, _, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for x in arcs[a]:
                b, capacity, cost, _ = x
                if capacity and b not in done and (far := d + cost + potential[a] - potential[b]) < dist.get(b, far + 1):
                    dist[b], via[b], order = far, x, order + 1
                    heapq.heappush(heap, (far, order, b))
        farthest = max(dist.values())
        for a in list(arcs):
            potential[a] += dist.get(a, farthest)
        path, a = [], "to"
        while a != "from":
            path.append(via[a])
            a = via[a][3][0]
        n = min(left, *(x[1] for x in path))
        for x in path:
            x[1] -= n
            x[3][1] += n
        left -= n

    leaving = {s: sum(x[3][1] for x in arcs[(0, s)] if x[0] == "hub") for s in old}
    arriving = {s: x[3][1] for s, x in moved_to.items()}
    # The hub's flow as transfers; a shard that both loses and gains rows would not be cheapest.
    moves, takers = {}, [[s, n] for s, n in sorted(arriving.items()) if n]
    for s in old:
        n = leaving[s]
        while n:
            taker = takers[0]
            k = min(n, taker[1])
            moves[s, taker[0]] = k
            n, taker[1] = n - k, taker[1] - k
            if not taker[1]:
                takers.pop(0)
    return moves


def margins(rows_of: dict[int, int], over: dict[int, int], marginal: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """Blocks for solve(): of a shard's `over` smallest rows all but the last leave at any rate, the last at its size, the others
    only after it."""
    return {s: [(c, n) for c, n in ((1, over[s] - 1), (marginal[s], 1), (marginal[s] + 1, rows_of[s] - over[s])) if n] if s in over else [(1, rows_of[s])]
            for s in rows_of}


def at_rank(keyed: DataFrame, classes: dict[int, dict[int, int]], ranks: dict[int, int]) -> dict[int, tuple[int, int]]:
    """keyed (old, size) -> for each shard the size of its row of that rank (from 1, by size), and how many rows of that size there
    are up to it. Size classes are cut into CUTS parts until one is one size: a few passes, shards x CUTS counts each."""
    spark, at = keyed.sparkSession, {}
    for s, rank in ranks.items():
        for block in sorted(classes[s]):
            if rank <= classes[s][block]:
                at[s] = [block, block + max(1, 2 ** (block.bit_length() - 1 - FINE)) if block else 1, rank]
                break
            rank -= classes[s][block]
    while open_ := {s: x for s, x in at.items() if x[1] - x[0] > 1}:
        step = {s: -(-(high - low) // CUTS) for s, (low, high, _) in open_.items()}
        spans = spark.createDataFrame([(s, low, high, step[s]) for s, (low, high, _) in open_.items()], "of int, low bigint, high bigint, step bigint")
        inside = keyed.join(F.broadcast(spans), (F.col("old") == F.col("of")) & (F.col("size") >= F.col("low")) & (F.col("size") < F.col("high")))  # a row a shard
        counts: dict = defaultdict(dict)
        for r in inside.groupBy("old", F.expr("(size - low) div step").alias("part")).count().collect():
            counts[r.old][r.part] = r["count"]
        for s, x in open_.items():
            for part in sorted(counts[s]):
                if x[2] <= counts[s][part]:
                    low = x[0] + part * step[s]
                    at[s] = [low, min(low + step[s], x[1]), x[2]]
                    break
                x[2] -= counts[s][part]
    return {s: (low, rank) for s, (low, _, rank) in at.items()}


def _tree(pairs: list[tuple[Column, int]], otherwise: int) -> Column:
    column = None
    for when, value in pairs:
        column = F.when(when, value) if column is None else column.when(when, value)
    return F.lit(otherwise) if column is None else column.otherwise(otherwise)


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """rows (old_shard int, doc_id, size long, text_crc32 long) -> the same and shard int, slot long: the new
    shard, and the row's place in it, gapless from 0."""
    spark = rows.sparkSession
    prepare(spark)
    slices = partitions(spark, 64)
    keyed = saved(rows.select(
        F.coalesce(F.col("old_shard"), F.lit(-1)).cast("int").alias("old"), "doc_id", "size", "text_crc32",
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slices)).cast("int").alias("slice")), "reshard-rows")

    # 1. How many rows stay in a shard differs by one at most, so all that the flow decides is whether a shard's marginal row
    # leaves, the largest of those that may have to: its exact size is the cost, and the result the fewest bytes.
    classes: dict = defaultdict(dict)
    for r in keyed.groupBy("old", size_class(F.col("size")).alias("block")).count().collect():  # shards x size classes
        classes[r.old][r.block] = r["count"]
    rows_of = {s: sum(c.values()) for s, c in classes.items()}
    least = sum(rows_of.values()) // shards
    over = {s: n - (least if 0 <= s < shards else 0) for s, n in rows_of.items()}
    over = {s: n for s, n in over.items() if n > 0}
    marginal = {s: size for s, (size, _) in at_rank(keyed, classes, over).items()}
    moves = solve(margins(rows_of, over, marginal), shards)
    give: dict = defaultdict(int)
    for (s, _), n in moves.items():
        give[s] += n

    # 2. The smallest rows go: the size up to which all go, and how many of the next size.
    found = at_rank(keyed, classes, {s: n for s, n in give.items() if n})
    cut, rest = {s: size for s, (size, _) in found.items()}, {s: n for s, (_, n) in found.items()}
    at = _tree([(F.col("old") == s, size) for s, size in cut.items()], -1).cast("bigint")
    # 3. Of the rows of that next size the first ones by slice; groups are ranked in slices.
    part = F.when(F.col("size") < at, "move").when(F.col("size") == at, "edge").otherwise("stay")
    parted = keyed.withColumn("part", part)
    counts: dict = defaultdict(dict)
    for r in parted.groupBy("old", "part", "slice").count().collect():  # shards x 3 x slices
        counts[r.old, r.part][r.slice] = r["count"]
    first = []
    for (s, p), n in counts.items():
        before = 0
        for k in sorted(n):
            first.append((s, p, k, before))
            before += n[k]
    offsets = spark.createDataFrame(first, "old int, part string, slice int, before bigint")
    in_slice = Window.partitionBy("old", "part", "slice").orderBy("size", "doc_id", "text_crc32")
    ranked = (parted.withColumn("rank", F.row_number().over(in_slice) - 1)
              .join(F.broadcast(offsets), ["old", "part", "slice"])  # at most shards x 3 x slices rows
              .withColumn("rank", F.col("rank") + F.col("before")))

    # 4. From the rank to shard and slot: of a shard's rows of the edge size the first go as well.
    total = {k: sum(n.values()) for k, n in counts.items()}
    spans, slot_from = [], {}
    filled = [0] * shards
    for s in sorted(rows_of):  # what stays comes first in its shard
        if 0 <= s < shards:
            stays = total.get((s, "stay"), 0) + total.get((s, "edge"), 0) - rest.get(s, 0)
            filled[s] = stays
    for s in sorted(rows_of):
        here = total.get((s, "move"), 0)
        begin = 0
        for (a, t), n in sorted(moves.items()):
            if a != s:
                continue
            # ranks [begin, begin+n) of all that moves: first the smaller rows, then those of the edge size
            for p, low, high, shift in (("move", begin, min(begin + n, here), 0), ("edge", max(begin, here) - here, begin + n - here, here)):
                if low < high:
                    spans.append((s, p, low, high, t, filled[t] - begin + shift))
            filled[t] += n
            begin += n
        slot_from[s] = rest.get(s, 0)
    for s in sorted(rows_of):
        if 0 <= s < shards:
            stay = total.get((s, "stay"), 0)
            spans += [(s, "stay", 0, stay, s, 0)] * bool(stay)
            if (edge := total.get((s, "edge"), 0)) > slot_from[s]:
                spans.append((s, "edge", slot_from[s], edge, s, stay - slot_from[s]))
    plan = spark.createDataFrame(spans, "old int, part string, low bigint, high bigint, shard int, shift bigint")
    placed = ranked.alias("r").join(F.broadcast(plan.alias("p")), (F.col("r.old") == F.col("p.old")) & (F.col("r.part") == F.col("p.part")) & (F.col("r.rank") >= F.col("p.low")) & (F.col("r.rank") < F.col("p.high")))  # at most shards^2 rows
    return placed.select(F.nullif(F.col("r.old"), F.lit(-1)).alias("old_shard"), "doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("shift")).alias("slot"))


def sized(docs: DataFrame, old_shard: Column) -> DataFrame:
    """docs (doc_id, text, ...) -> old_shard, doc_id, size (UTF-8 bytes and HEADER), text_crc32 (unsigned)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(old_shard.cast("int").alias("old_shard"), "doc_id", (F.octet_length(text) + HEADER).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))


def rewrite(docs: DataFrame, old_shard: Column, placed: DataFrame, target: str) -> list[int]:
    """Write the shards that gain or lose rows to `target` (folders shard=N, rows in slot order within a file);
    returns them. The others' files stay as they are. docs: the rows that were placed by assign(); rows that
    agree in old shard, doc_id, size and checksum are the same row and interchangeable."""
    spark = docs.sparkSession
    prepare(spark)
    placed = saved(placed, "reshard-placed")
    moving = placed.where(~F.col("old_shard").eqNullSafe(F.col("shard"))).select("old_shard", "shard").distinct().collect()  # shards^2
    affected = sorted({s for r in moving for s in (r.old_shard, r.shard) if s is not None})
    keys = ["old_shard", "doc_id", "size", "text_crc32"]
    mine = placed.where(F.col("shard").isin(affected)) if affected else placed.limit(0)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.withColumns({"old_shard_": old_shard.cast("int"), "size_": (F.octet_length(text) + HEADER).cast("bigint"), "crc_": F.crc32(text)})
    on = own["old_shard_"].eqNullSafe(mine["old_shard"]) & own["doc_id"].eqNullSafe(mine["doc_id"]) & (own["size_"] == mine["size"]) & (own["crc_"] == mine["text_crc32"])
    out = own.dropDuplicates(["old_shard_", "doc_id", "size_", "crc_"]).join(mine, on).select(
        *(own[c] for c in docs.columns if c not in ("shard", "slot")), mine["shard"], mine["slot"])
    spread = partitions(spark)
    (out.repartition(spread, "shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").mode("overwrite").parquet(target))
    return affected
