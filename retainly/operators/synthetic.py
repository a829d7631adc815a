"""Synthetic minority rows (T5): new rows between a row and one of its nearest neighbours of the same class.

Neighbours are exact at any size. Rows with equal scaled features are one vector,
which carries its k + 1 first keys. Vectors are halved at the mean of their widest
feature, again and again, into leaves of at most BUCKET, whose boxes the driver
holds; neighbouring leaves make up groups of at most GROUP leaves' worth. A vector first
meets its own group. The distance of the last of its nearest then says which
leaves of other groups may hold nearer ones: those whose box is no farther.
Groups meet two by two, so no task holds more than two of them; how the leaves lie
decides the cost and never the result. At worst, where boxes tell nothing, each
group meets each other one.

A new row is x + u (y - x) for a row x, one of its neighbours y and a share u,
both chosen by hashes of key, copy and seed: the same on every run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .dataset import hash_unit, scaling_params, standard_scale

BUCKET = 1024
GROUP = 16  # leaves of BUCKET vectors
LEAVES = 4096  # beyond, leaves grow
SIDE = 256  # vectors whose distances are weighed side by side


def _matrix(column) -> np.ndarray:
    """A list column as rows of numbers."""
    flat = [np.asarray(c.flatten()) for c in getattr(column, "chunks", [column])]
    return np.concatenate(flat).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _leaf(x: np.ndarray, tree: list[tuple]) -> np.ndarray:
    """The leaf of each row of x; tree: by node feature (-1: a leaf), cut, and the nodes below it."""
    feature, cut, left, right = map(np.array, zip(*tree))
    at = np.zeros(len(x), np.int64)
    while len(x) and (own := np.flatnonzero(feature[at] >= 0)).size:
        node = at[own]
        at[own] = np.where(x[own, feature[node]] <= cut[node], left[node], right[node])
    return at


def _grown(vectors: DataFrame, wide: int) -> list[tuple]:
    """The tree; each pass halves all leaves with over BUCKET vectors."""
    tree, n, wait = [(-1, 0.0, -1, -1)], vectors.count(), {0}
    for _ in range(2 * math.ceil(math.log2(max(1, n) / BUCKET)) + 4 if n > BUCKET else 0):
        if not wait or len(tree) > 2 * LEAVES:
            break
        now, own = list(tree), sorted(wait)

        def placed(batches):
            for b in batches:
                at = _leaf(_matrix(b.column(0)), now)
                use = np.isin(at, own)
                yield pa.RecordBatch.from_arrays([pa.array(at[use]), b.column(0).filter(pa.array(use))], names=["node", "x"])

        each = vectors.select("x").mapInArrow(placed, "node bigint, x array<double>").groupBy("node")
        found = each.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("x", F.lit(d))) for d in range(wide)]).alias("mean"),
                         F.array(*[F.var_pop(F.get("x", F.lit(d))) for d in range(wide)]).alias("spread")).collect()  # a row a leaf
        wait = set()
        for r in found:
            d = int(np.argmax(r.spread))
            if r.n > BUCKET and r.spread[d] > 0:
                tree[r.node] = (d, r["mean"][d], len(tree), len(tree) + 1)
                wait |= {len(tree), len(tree) + 1}
                tree += [(-1, 0.0, -1, -1)] * 2
    return tree


def _groups(tree: list[tuple], count: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """By node its first group and in how many groups its vectors lie, along the tree."""
    first, pieces = np.zeros(len(tree), np.int64), np.ones(len(tree), np.int64)
    most, at, room, stack = GROUP * BUCKET, -1, 0, [0]
    while stack:
        node = stack.pop()
        if tree[node][0] >= 0:
            stack += [tree[node][3], tree[node][2]]
            continue
        n = count.get(node, 0)
        if n > room:
            first[node], pieces[node] = at + 1, -(-n // most)
            at += int(pieces[node])
            room = most - n if n <= most else 0
        else:
            first[node], room = max(at, 0), room - n
    return first, pieces


def _closest(x: np.ndarray, reach: np.ndarray, y: np.ndarray, count: np.ndarray, order: np.ndarray, most: int):
    """Of each row of x the `most` nearest points, by distance and order: row of x, distance, point. A row of y is `count` points, one
    after the other. Points beyond `reach` may be left out."""
    square, first, found = (y * y).sum(1), np.cumsum(count) - count, []
    for a in range(0, len(x), SIDE):
        q = x[a : a + SIDE]
        own = (q * q).sum(1)
        d = own[:, None] + square - 2 * q @ y.T
        slack = 1e-12 * (own + square.max(initial=0.0))  # far above what rounding takes off
        limit = reach[a : a + SIDE] ** 2 * (1 + 1e-12) + slack
        near = d <= limit[:, None]
        if len(y) > most and near.sum() > 8 * most * len(q):
            near = d <= np.minimum(limit, np.partition(d, most - 1, axis=1)[:, most - 1] + 2 * slack)[:, None]
        r, c = np.nonzero(near)
        exact = np.sqrt(((q[r] - y[c]) ** 2).sum(1))
        rep = np.repeat(np.arange(len(r)), count[c])
        point = first[c][rep] + np.arange(len(rep)) - (np.cumsum(count[c]) - count[c])[rep]
        found.append(_first(r[rep] + a, exact[rep], point, order, most))
    return [np.concatenate(z) for z in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]


def _first(row: np.ndarray, distance: np.ndarray, point: np.ndarray, order: np.ndarray, most: int):
    by = np.lexsort((order[point], distance, row))
    row, distance, point = row[by], distance[by], point[by]
    use = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[use], distance[use], point[use]


def neighbours(df: DataFrame, key: str, features, k: int = 5) -> DataFrame:
    """df (key unique, features...) -> key, neighbour, distance, nth (1..k): each row's k nearest others by Euclidean distance of scaled
    features, ties by key. NULL counts as 0. Rows without any other have none."""
    features, most = list(features), k + 1
    filled = df.select(key, *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
    scaled = standard_scale(filled, features, scaling_params(filled, features))
    rows = materialize(scaled.select(F.col(key).alias("row"), F.array(*[F.nanvl(f, F.lit(0.0)) for f in features]).alias("x")))
    kind = rows.schema["row"].dataType.simpleString()
    some = rows.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy("row"))).where(F.col("nth") <= most)
    vectors = some.groupBy("x").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # k + 1 at most
    vectors = materialize(vectors.withColumn("id", F.monotonically_increasing_id()))
    tree = _grown(vectors, len(features))

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_leaf(_matrix(b.column(0)), tree))], names=["x", "rows", "id", "leaf"])

    vectors = materialize(vectors.mapInArrow(placed, f"x array<double>, rows array<{kind}>, id bigint, leaf bigint"))
    ends = [F.array(*[end(F.get("x", F.lit(d))) for d in range(len(features))]).alias(name) for name, end in (("low", F.min), ("high", F.max))]
    boxes = vectors.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).collect()  # LEAVES at most, or twice as many
    low, high = (np.array([r[c] for r in boxes], np.float64).reshape(len(boxes), len(features)) for c in ("low", "high"))
    box = {r.leaf: at for at, r in enumerate(boxes)}
    first, pieces = _groups(tree, {r.leaf: r.n for r in boxes})
    spots = [(at, int(first[leaf]) + piece) for leaf, at in box.items() for piece in range(int(pieces[leaf]))]  # a box and a group that has some of it
    spot_box, spot_group = (np.array(z, np.int64) for z in zip(*spots)) if spots else (np.empty(0, np.int64),) * 2

    def grouped(batches):
        for b in batches:
            ids, leaf = np.asarray(b.column(2)), np.asarray(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[leaf] + ids % pieces[leaf])], names=["x", "rows", "id", "leaf", "group"])

    vectors = vectors.mapInArrow(grouped, f"x array<double>, rows array<{kind}>, id bigint, leaf bigint, group bigint")

    def points(table):
        """Vectors, how many keys each has, the keys and their order."""
        keys = table.column("rows").combine_chunks()
        flat = keys.flatten()
        return _matrix(table.column("x")), np.asarray(pc.list_value_length(keys)), flat, np.asarray(pc.rank(flat, tiebreaker="dense")).astype(np.int64)

    def at_home(table):
        x, count, keys, order = points(table)
        row, distance, point = _closest(x, np.full(len(x), np.inf), x, count, order, most)
        ends = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
        full = np.diff(ends) == most
        reach = np.where(full, distance[np.where(full, ends[1:] - 1, 0)], np.inf)
        return pa.table([table.column("id"), table.column("group"), table.column("x"), pa.array(reach), pa.ListArray.from_arrays(ends, pa.array(distance)), pa.ListArray.from_arrays(ends, keys.take(pa.array(point)))],
                        names=["id", "group", "x", "reach", "distance", "neighbour"])

    home = materialize(vectors.groupBy("group").applyInArrow(at_home, f"id bigint, group bigint, x array<double>, reach double, distance array<double>, neighbour array<{kind}>"))
    near = home.select("id", F.explode(F.arrays_zip("distance", "neighbour")).alias("s")).select("id", "s.distance", "s.neighbour")

    def away(x, reach, at):
        """Whether a box may hold points within reach."""
        off = np.zeros((len(x), len(at)))
        for d in range(x.shape[1]):
            off += np.maximum(np.maximum(low[at, d] - x[:, d, None], x[:, d, None] - high[at, d]), 0.0) ** 2
        return off > (reach**2 * (1 + 1e-9))[:, None]

    def visits(batches):
        for b in batches:
            ids, group, reach, x = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(3)), _matrix(b.column(2))
            for a in range(0, len(ids), SIDE):
                own = slice(a, a + SIDE)
                row, spot = np.nonzero(~away(x[own], reach[own], np.arange(len(box)))[:, spot_box])
                row, to = np.unique(np.stack([row, spot_group[spot]], 1), axis=0).T
                row, to = row[to != group[own][row]] + a, to[to != group[own][row]]
                yield pa.RecordBatch.from_arrays([pa.array(to), *(c.take(pa.array(row)) for c in b.columns)], names=["to", "id", "group", "x", "reach"])

    def abroad(guests, hosts):
        x, reach, ids = _matrix(guests.column("x")), np.asarray(guests.column("reach")), guests.column("id").combine_chunks()
        y, count, keys, order = points(hosts)
        leaf, first_key, found = np.asarray(hosts.column("leaf")), np.cumsum(count) - count, []
        for node in np.unique(leaf) if len(x) else ():
            come, here = np.flatnonzero(~away(x, reach, np.array([box[int(node)]]))[:, 0]), np.flatnonzero(leaf == node)
            own = np.concatenate([np.arange(first_key[h], first_key[h] + count[h]) for h in here])
            row, distance, point = _closest(x[come], reach[come], y[here], count[here], order[own], most)
            found.append((come[row], distance, own[point]))
        row, distance, point = _first(*(np.concatenate(z) for z in zip(*found)), order, most) if found else [np.empty(0, np.int64)] * 3
        return pa.table([ids.take(pa.array(row)), pa.array(distance, pa.float64()), keys.take(pa.array(point))], names=["id", "distance", "neighbour"])

    if len(set(spot_group.tolist())) > 1:
        guests = materialize(home.select("id", "group", "x", "reach").mapInArrow(visits, "to bigint, id bigint, group bigint, x array<double>, reach double"))
        pairs = guests.select(F.col("to").alias("host"), F.col("group").alias("guest")).distinct()
        hosts = vectors.join(pairs, F.col("group") == F.col("host")).select("host", "guest", "leaf", "x", "rows")
        met = guests.groupBy("to", "group").cogroup(hosts.groupBy("host", "guest")).applyInArrow(abroad, f"id bigint, distance double, neighbour {kind}")
        near = near.unionByName(met)
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, most).alias("s"))  # k + 1 a group met
    each = rows.join(best.join(vectors.select("id", "x"), "id"), "x")
    at = F.array_position(F.transform("s", lambda e: e.neighbour), F.col("row")).cast("int")  # the row itself is nearest, but not among the first of many equals
    others = F.when(at > 0, F.concat(F.slice("s", F.lit(1), at - 1), F.slice("s", at + 1, F.lit(most)))).otherwise(F.col("s"))
    found = each.select("row", F.explode(F.slice(others, 1, k)).alias("e")).select("row", "e.distance", "e.neighbour")
    few = found.groupBy("row").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "neighbour"))), 1, k).alias("s"))  # k a row
    return few.select(F.col("row").alias(key), F.posexplode("s").alias("at", "s")).select(key, "s.neighbour", "s.distance", (F.col("at") + 1).alias("nth"))


def synthetic_minority(df: DataFrame, key: str, label: str, features, minority=1, copies: int = 2, k: int = 5, seed: int = 42) -> DataFrame:
    """df (key unique, label, features...) -> key, label, copy (1..copies), neighbour, share, features... as doubles: `copies` new rows for
    each row of the minority class that has another. Rows without a label or key are of no class."""
    features = list(features)
    rows = df.where((F.col(label) == F.lit(minority)) & F.col(key).isNotNull()).select(
        key, label, *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
    rows = materialize(rows)
    near = neighbours(rows, key, features, k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour"))).alias("near"))  # k at most
    drawn = rows.join(near, key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    named = drawn.withColumn("_draw", F.concat_ws("-", F.col(key).cast("string"), "copy"))
    named = named.withColumn("neighbour", F.get("near", F.floor(hash_unit("_draw", seed) * F.size("near")).cast("int"))["neighbour"]).withColumn("share", hash_unit("_draw", seed + 1))
    other = rows.select(F.col(key).alias("neighbour"), *[F.col(f).alias(f"_{f}") for f in features])
    return named.join(other, "neighbour").select(key, label, F.col("copy").cast("bigint").alias("copy"), "neighbour", "share",
                                                 *[(F.col(f) + F.col("share") * (F.col(f"_{f}") - F.col(f))).alias(f) for f in features])
