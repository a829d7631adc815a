"""Near-duplicate vectors by product quantisation.

Unit vectors are filed in coarse inverted lists (the nearest of some centroids)
and kept there as codes: the residual to the centroid is cut into subspaces of
SUB components, each stored as the number of its nearest codeword. A vector's
code visits the lists that a close vector may lie in; there the whole vectors
are held against the visiting codes by table look-ups of asymmetric inner
products. With the code goes the length of what quantisation left of the
residual, by which the true cosine can at most exceed the looked-up one, so no
pair is lost in this step. What is left is ranked again by its exact cosine in
double precision, whole vector against whole vector; only that makes links.

Sufficient probes: a vector x with nearest centroid c visits each list whose
bisecting plane with c is nearer than a reach. The reach is fitted on a sample
of SAMPLE vectors: sample vectors are turned, towards other sample vectors, by
the very angle of the threshold, and the reach is what FOUND of these pairs need.

Equal vectors of a label are one node with a count. Lists and pairs of lists
with more than BLOCK nodes are cut into blocks and each pair of blocks is worked
on by itself: no task holds a list, and a node's copies are as many as a list
has blocks. Pairs never leave a task: it gives counts of links and links that
span what it saw. The model and the sample are the only data on the driver.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do rows without a label; vectors of different lengths don't
link. Each row counts as a vector, equal vec_ids too; a null vec_id is no name,
so a component of such rows alone has a null component_id, which counts as kept.
An empty table has an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved
from .graph import components

SAMPLE = 20_000  # vectors that the quantisers are fitted on, and SAMPLE_VALUES components at most
SAMPLE_VALUES = 2**23
LIST = 1024  # nodes that a list holds on average, while lists are fewer than LISTS
LISTS = 4096
SUB = 4  # components of a subspace
WORDS = 256  # codewords of a subspace
ROUNDS = 8  # of k-means
FOUND = 0.998  # share of the sample's turned pairs within reach
BLOCK = 1024  # nodes of a list that a task works on at once
SEED = 11


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 4096] @ centres.T, 1) for a in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres (fewer if there are fewer distinct rows); a centre that loses all its rows stays where it was."""
    centres = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        held = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[held])[:-1]]), axis=0)
        centres[held] = sums / count[held, None]
    return centres


class Model:
    """Coarse centroids, codewords of the residuals' subspaces, and the reach of the probes."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float):
        """sample: unit vectors, one a row; n: number of nodes; cosine: the threshold."""
        rng = np.random.default_rng(SEED)
        self.cosine, dims = cosine, sample.shape[1]
        self.centres = kmeans(sample, max(1, min(LISTS, n // LIST, len(sample) // 8, SAMPLE_VALUES // dims)), rng)
        square = (self.centres**2).sum(1)
        self.apart = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * self.centres @ self.centres.T, 1e-30))
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.parts = [slice(a, min(a + SUB, dims)) for a in range(0, dims, SUB)]
        self.words = [kmeans(rest[:, p], WORDS, rng) for p in self.parts]
        self.reach = self._reach(sample, rng)

    def margins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own list, and its distance to the planes between that list and each."""
        square = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        own = np.argmin(square, 1)
        return own, (square - square[np.arange(len(x)), own][:, None]) / (2 * self.apart[own])

    def _reach(self, sample: np.ndarray, rng: np.random.Generator) -> float:
        a = sample[rng.permutation(len(sample))[:4096]]
        towards = sample[rng.integers(len(sample), size=len(a))]
        aside = towards - (towards * a).sum(1)[:, None] * a
        size = np.linalg.norm(aside, axis=1)
        ok = size > 1e-6
        if not ok.any():
            return 0.0
        a, aside = a[ok], aside[ok] / size[ok, None]
        b = self.cosine * a + np.sqrt(max(0.0, 1 - self.cosine**2)) * aside
        (own_a, from_a), (own_b, from_b) = self.margins(a), self.margins(b)
        rows = np.arange(len(a))
        return float(np.quantile(np.minimum(from_a[rows, own_b], from_b[rows, own_a]), FOUND))

    def encode(self, x: np.ndarray):
        """Unit vectors -> list, lists to visit, codes, and the length of what quantisation leaves."""
        own, margin = self.margins(x)
        near = margin <= self.reach
        near[np.arange(len(x)), own] = True
        rest = x - self.centres[own]
        codes = np.stack([nearest(rest[:, p], w) for p, w in zip(self.parts, self.words)], 1).astype(np.uint8)
        for j, (p, w) in enumerate(zip(self.parts, self.words)):
            rest[:, p] -= w[codes[:, j]]
        return own, [np.flatnonzero(r) for r in near], codes, np.linalg.norm(rest, axis=1)

    def candidates(self, whole: np.ndarray, lists: np.ndarray, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Whole vectors against codes -> which pairs may reach the threshold: a table of inner products with the codewords
        for each whole vector, added up by the codes."""
        held, which = np.unique(lists, return_inverse=True)
        made = (whole @ self.centres[held].T)[:, which]
        for j, (p, w) in enumerate(zip(self.parts, self.words)):
            made += (whole[:, p] @ w.T)[:, codes[:, j]]
        return made + left >= self.cosine - 1e-6


def unit(vector: Column) -> Column:
    """An array of numbers as doubles; null where a vector links with nothing: null or non-finite components, or all zero."""
    v = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return F.when(sound, v)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column as unit vectors, one a row, filled up with zeros to dims."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets) - column.offsets[0].as_py()
    size = np.diff(at)
    if (size == dims).all():
        x = flat.reshape(-1, dims).copy()
    else:
        x = np.zeros((len(size), dims))
        x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _column(table, name):
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(table, name) -> np.ndarray:
    return np.asarray(_column(table, name))


def _blocked(rows: DataFrame, unit_of: list[str], side: str) -> DataFrame:
    """rows (unit_of..., side 0 or 1, node, ...) -> the same with own_block and other_block: where a unit has over BLOCK rows on a
    side, that side is cut into blocks and every block of one side meets every one of the other."""
    hot = (rows.groupBy(*unit_of).agg(*(F.ceil(F.count(F.when(F.col(side) == k, 1)) / BLOCK).cast("int").alias(f"blocks{k}") for k in (0, 1)))
           .where(F.greatest("blocks0", "blocks1") > 1))
    hot = saved(hot.select(*(F.col(c).alias(f"{c}_of") for c in unit_of), "blocks0", "blocks1"), "hot-lists")
    if hot.isEmpty():
        return rows.withColumns({"block0": F.lit(0), "block1": F.lit(0)})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in unit_of]
    met = rows.join(hot, same, "left").drop(*(f"{c}_of" for c in unit_of))
    blocks = [F.greatest(F.coalesce(f"blocks{k}", F.lit(1)), F.lit(1)) for k in (0, 1)]
    first = F.col(side) == 0
    own = F.pmod(F.xxhash64("node"), F.when(first, blocks[0]).otherwise(blocks[1])).cast("int")
    others = F.sequence(F.lit(0), F.when(first, blocks[1]).otherwise(blocks[0]) - 1)
    met = met.withColumn("own_block", own).withColumn("other_block", F.explode(others))
    return met.withColumns({"block0": F.when(first, F.col("own_block")).otherwise(F.col("other_block")),
                            "block1": F.when(first, F.col("other_block")).otherwise(F.col("own_block"))}).drop("own_block", "other_block", "blocks0", "blocks1")


def nodes_of(vectors: DataFrame, id_column: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """-> the rows as (id, key1, key2: of the node, null for those that link with nothing), and the nodes, saved: (node, key1, key2,
    label, dims, vec, copies, least: the smallest id)."""
    made = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), unit(F.col(vector)).alias("vec"))
    able = F.col("label").isNotNull() & F.col("vec").isNotNull()
    key = [F.when(able, F.xxhash64(F.lit(k), "label", "vec")).alias(f"key{k}") for k in (1, 2)]
    rows = made.select("id", *key, "label", "vec")
    nodes = rows.where("key1 is not null").groupBy("key1", "key2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "key1", "key2", "label", F.size("vec").alias("dims"), "vec", "copies", "least")
    return rows.drop("label", "vec"), saved(nodes, "vector-nodes")


def links(nodes: DataFrame, cosine: float) -> DataFrame:
    """nodes (node, label, dims, vec, copies) -> a, b, links, saved: rows with b are links or join what links connect; rows without
    count vectors that node a links with, to be summed up."""
    spark = nodes.sparkSession
    prepare(spark)
    kind = nodes.schema["label"].dataType.simpleString()
    schema = "a bigint, b bigint, links bigint"
    n, dims = nodes.agg(F.count(F.lit(1)), F.max("dims")).first()
    if not n:
        return spark.createDataFrame([], schema)
    bound = max(256, min(SAMPLE, SAMPLE_VALUES // dims))
    sample = nodes.orderBy(F.xxhash64("key1"), "key2").limit(bound).select("vec").toArrow()
    shared = spark.sparkContext.broadcast(Model(_rows(sample.column(0), dims), n, cosine))  # some 4 MB at 64 components

    def filed(batches):
        for b in batches:
            if b.num_rows:
                own, visits, codes, left = shared.value.encode(_rows(b.column(2), dims))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(3), pa.array(own.astype(np.int32)), pa.array([v.astype(np.int32) for v in visits], pa.list_(pa.int32())),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=["node", "label", "dims", "list", "visits", "code", "rest"])

    codes = saved(nodes.select("node", "label", "vec", "dims").mapInArrow(filed, f"node bigint, label {kind}, dims int, list int, visits array<int>, code binary, rest double"), "vector-codes")
    none = lambda t: F.lit(None).cast(t)
    whole = nodes.join(codes.select("node", "list"), "node").select(
        "label", "dims", "list", F.lit(0).alias("side"), "node", "vec", none("int").alias("home"), none("binary").alias("code"), none("double").alias("rest"))
    visiting = codes.select("label", "dims", F.explode("visits").alias("list"), F.lit(1).alias("side"), "node", none("array<double>").alias("vec"), F.col("list").alias("home"), "code", "rest")
    # A list without whole vectors of that label and length has nothing to visit.
    visiting = visiting.join(codes.select("label", "dims", "list").distinct(), ["label", "dims", "list"], "left_semi").select(*whole.columns)
    met = _blocked(whole.unionByName(visiting), ["label", "dims", "list"], "side")

    def looked_up(table):
        side = _numbers(table, "side")
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        out = []
        if a.num_rows and b.num_rows:
            own, nodes_a, nodes_b, homes = int(_numbers(a, "list")[0]), _numbers(a, "node"), _numbers(b, "node"), _numbers(b, "home")
            code = np.frombuffer(b"".join(_column(b, "code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            x, rest = _rows(_column(a, "vec"), dims), _numbers(b, "rest")
            for k in np.unique(homes):
                of = np.flatnonzero(homes == k)
                may = shared.value.candidates(x, homes[of], code[of], rest[of])
                may &= nodes_a[:, None] != nodes_b[of][None]
                low, high = min(own, int(k)), max(own, int(k))
                for found, side in ((nodes_a[may.any(1)], int(own != low)), (nodes_b[of][may.any(0)], int(k != low))):
                    out.append((np.full(len(found), low, np.int32), np.full(len(found), high, np.int32), np.full(len(found), side, np.int32), found))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int32)] * 3 + [np.empty(0, np.int64)]
        label, dim = _column(table, "label")[0], _column(table, "dims")[0]
        return pa.table([pa.array([label.as_py()] * len(cols[0]), label.type), pa.array([dim.as_py()] * len(cols[0]), pa.int32()), *map(pa.array, cols)],
                        names=["label", "dims", "low", "high", "side", "node"])

    asked = saved(met.groupBy("label", "dims", "list", "block0", "block1").applyInArrow(looked_up, f"label {kind}, dims int, low int, high int, side int, node bigint").distinct(), "vector-candidates")
    # Within one list all nodes stand on both sides, so that blocks of a list meet like blocks of two.
    both = asked.withColumn("side", F.explode(F.when(F.col("low") == F.col("high"), F.array(F.lit(0), F.lit(1))).otherwise(F.array("side"))))
    ranked = _blocked(both, ["label", "dims", "low", "high"], "side")
    ranked = ranked.join(nodes.select("node", "vec", "copies"), "node")

    def exact(table):
        side = _numbers(table, "side")
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "links"])
        node_a, node_b = _numbers(a, "node"), _numbers(b, "node")
        near = _rows(_column(a, "vec"), dims) @ _rows(_column(b, "vec"), dims).T >= cosine
        near &= node_a[:, None] != node_b[None]
        within = _numbers(a, "low")[0] == _numbers(a, "high")[0]
        counted = [(node_a, near @ _numbers(b, "copies"))] + ([] if within else [(node_b, _numbers(a, "copies") @ near)])
        ends = []
        for i, j in _spanning(near):
            ends.append((node_a[i], node_b[j]))
        first = np.concatenate([*(c[0][c[1] > 0] for c in counted), np.array([e[0] for e in ends], np.int64)])
        more = sum(int((c[1] > 0).sum()) for c in counted)
        second = pa.array([None] * more + [int(e[1]) for e in ends], pa.int64())
        links = pa.array([int(v) for c in counted for v in c[1][c[1] > 0]] + [None] * len(ends), pa.int64())
        return pa.table([pa.array(first.astype(np.int64)), second, links], names=["a", "b", "links"])

    return saved(ranked.groupBy("label", "dims", "low", "high", "block0", "block1").applyInArrow(exact, schema), "vector-links")


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Of a table of links between rows and columns, ones that connect all that it connects."""
    rows, cols, made = np.zeros(near.shape[0], bool), np.zeros(near.shape[1], bool), []
    for start in range(near.shape[0]):
        if rows[start]:
            continue
        rows[start], front = True, [start]
        while front:
            i = front.pop()
            new = np.flatnonzero(near[i] & ~cols)
            made += [(i, j) for j in new]
            cols[new] = True
            if len(new):
                seen = np.flatnonzero(near[:, new].any(1) & ~rows)
                for k in seen:
                    made.append((k, new[np.argmax(near[k, new])]))
                rows[seen] = True
                front += seen.tolist()
    return made


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vectors (vec_id, embedding, label, ...) -> vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id
    reachable by links), kept (vec_id is component_id). One row for each row of vectors."""
    prepare(vectors.sparkSession)
    rows, nodes = nodes_of(vectors, id_column, vector, label)
    found = links(nodes, cosine)
    roots = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    rooted = nodes.select("node", "key1", "key2", "copies", "least").join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    rooted = saved(rooted.join(counts, F.col("node") == F.col("a"), "left")
                   .select("key1", "key2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"), "least"), "vector-components")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "n_links", "component_id")
    # Every row has one node at most; copies of one vector are a hot key here, which the skew join splits.
    out = rows.join(named, (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left")
    component = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
