"""Leaf-wise boosted trees on binned features (T8, and the knobs that T7 lacks).

Features are cut into at most BINS bins at approximate quantiles. A tree grows
best leaf first: of all leaves the one whose split gains most is split next,
until there are `leaves` of them. A split needs the sums of gradients and
hessians of each bin of its leaf; Spark adds those up over all rows, a whole
generation of leaves in one pass, and only sums by (leaf, feature, bin) come to
the driver, one set a task at most. Leaves that may still be chosen are looked at ahead of their turn,
so a tree takes about as many passes as it is deep.

Of two sibling leaves the one with fewer rows is added up; the other's sums are
what is left of their parent's.

Sums are of whole numbers (gradients times 2^24), so a tree depends neither on
the order of rows nor on tasks, and a task that runs again changes nothing. Rows
are kept in blocks of TASK_ROWS, one table row each, as every pass reads them.
Margins are saved every KEEP rounds; between that the last trees are walked anew.
Boosting stops when the loss on the validation rows has not fallen for
`patience` rounds, and the trees after the best round go.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_defaults, scratch_path

BINS = 64
KEEP = 10
TASK_ROWS = 100_000
LEAST_ROWS = 10_000
FEW = 64  # tasks whose sums are added up by the driver
SIDE = 64  # leaves whose splits are weighed side by side
PACK = {"key": np.int64, "label": np.float64, "weight": np.float64, "held": np.bool_, "bins": np.uint8, "margin": np.float64}
UNIT = 2.0**24
NUMBERS = "array<struct<feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,value:array<double>,cover:array<double>>>"


@dataclass(frozen=True)
class Settings:
    """rows and columns: shares that a tree is grown on; child_weight: least sum of hessians of a leaf; depth: 0 for any."""
    rounds: int = 200
    leaves: int = 31
    depth: int = 0
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    child_weight: float = 1e-3
    child_rows: int = 20
    l2: float = 0.0
    patience: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Nodes as columns; a leaf has feature -1. Rows with value <= threshold (bin <= cut) go left."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover)):
            column.append(x)
        return len(self.feature) - 1

    def place(self, bins: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row of bins; at: the nodes that the rows have come to."""
        at = np.zeros(len(bins), np.int64) if at is None else at
        feature, left, right = map(np.array, (self.feature, self.left, self.right))
        cut = np.array(self.cut, bins.dtype)
        leaf, own = feature < 0, np.arange(len(feature))
        if leaf.all() or not len(bins):
            return at
        child = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], 1).ravel()  # a leaf leads to itself
        feature, flat, start = np.maximum(feature, 0), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        while True:
            at = child[2 * at + (flat[start + feature[at]] > cut[at])]
            if leaf[at].all():
                return at


def kept_share(keys: np.ndarray, share: float, seed: int, of: int) -> np.ndarray:
    """A share of the keys, by a hash of key, seed and `of`: the same wherever it is asked."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + of * 0xBF58476D1CE4E5B9) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(2**64 - 1, int(share * 2**64)))


class Growth:
    """One tree as it grows. wanted(): leaves whose sums it needs; light(): those of them that must be added up; learn(): takes these;
    tree(): the grown tree."""

    def __init__(self, settings: Settings, features: int, number: int):
        self.settings, self.sketch, self.best = settings, Tree(), {}
        own = kept_share(np.arange(features), settings.columns, settings.seed + 1, number)
        self.own = own if own.any() else np.arange(features) == number % features
        self.sketch.add(0.0, 0.0)
        self.deep, self.order = [0], []
        self.cells, self.heavy = {}, {}  # of a leaf that may be split, its sums; of a light child, its sibling and their parent's sums

    def light(self, nodes: list[int]) -> list[int]:
        """Of each two siblings the one with fewer rows."""
        left_out = {heavy for heavy, _ in self.heavy.values()}
        return [n for n in nodes if n not in left_out]

    def learn(self, sums: np.ndarray, nodes: list[int]) -> None:
        """sums: by node, feature and bin: gradient, hessian, rows. A light child's give its sibling's too."""
        found = dict(zip(nodes, sums))
        for node in nodes:
            if node in self.heavy:
                heavy, cells = self.heavy.pop(node)
                found.setdefault(heavy, cells - found[node])  # exact: whole UNITs
        own = list(found)
        for k in range(0, len(own), SIDE):
            self._weigh(own[k : k + SIDE], np.stack([found[n] for n in own[k : k + SIDE]]))

    def _weigh(self, nodes: list[int], cells: np.ndarray) -> None:
        s, t = self.settings, self.sketch
        total = cells[:, 0].sum(1)
        g, h = total[:, 0], total[:, 1]
        low = np.cumsum(cells, 2)[:, :, :-1]
        high = total[:, None, None] - low
        gain = low[..., 0] ** 2 / (low[..., 1] + s.l2 + 1e-12) + high[..., 0] ** 2 / (high[..., 1] + s.l2 + 1e-12) - (g * g / (h + s.l2 + 1e-12))[:, None, None]
        allowed = (np.minimum(low[..., 1], high[..., 1]) >= s.child_weight) & (np.minimum(low[..., 2], high[..., 2]) >= max(1, s.child_rows)) & self.own[:, None]
        if s.depth:
            allowed &= np.array([self.deep[n] < s.depth for n in nodes])[:, None, None]
        gain = np.where(allowed, gain, -1.0)
        for k, (node, value) in enumerate(zip(nodes, -s.rate * g / (h + s.l2 + 1e-12))):
            t.value[node], t.cover[node] = value, float(h[k])
            at = int(np.argmax(gain[k])) if gain[k].size else 0
            self.best[node] = (float(gain[k].flat[at]), *np.unravel_index(at, gain[k].shape)) if gain[k].size and gain[k].flat[at] > 1e-9 else None
            if self.best[node]:
                self.cells[node] = cells[k].copy()

    def wanted(self) -> list[int]:
        """Goes through the splits, best first, as far as is known; gives the leaves that must be looked at first."""
        t, missing, queue, self.order, leaves = self.sketch, [] if 0 in self.best else [0], [], [], 1
        if not missing and self.best[0]:
            queue.append((-self.best[0][0], 0))
        while queue and leaves < self.settings.leaves:
            _, node = heapq.heappop(queue)
            self.order.append(node)
            leaves += 1
            if t.left[node] < 0:
                t.feature[node], t.cut[node] = map(int, self.best[node][1:])
                t.left[node], t.right[node] = t.add(0.0, 0.0), t.add(0.0, 0.0)
                self.deep += [self.deep[node] + 1] * 2
                cells = self.cells.pop(node)
                rows = cells[t.feature[node], :, 2]
                less, more = (t.left[node], t.right[node]) if 2 * rows[: t.cut[node] + 1].sum() <= rows.sum() else (t.right[node], t.left[node])
                self.heavy[less] = more, cells
            for child in (t.left[node], t.right[node]):
                if child not in self.best:
                    missing.append(child)
                elif self.best[child]:
                    heapq.heappush(queue, (-self.best[child][0], child))
        return missing

    def tree(self) -> Tree:
        made, split = Tree(), set(self.order)

        def copy(node: int) -> int:
            at = made.add(self.sketch.value[node], self.sketch.cover[node])
            if node in split:
                made.feature[at], made.cut[at] = self.sketch.feature[node], self.sketch.cut[node]
                made.left[at] = copy(self.sketch.left[node])
                made.right[at] = copy(self.sketch.right[node])
            return at

        copy(0)
        return made


def slopes(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the logistic loss, in whole UNITs."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(weight * (p - label) * UNIT), np.rint(np.maximum(weight * p * (1 - p), 1e-7) * UNIT)


def sums_by_bin(bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: list[int], size: int) -> np.ndarray:
    """Sums (node, feature, bin) of gradients, hessians and rows, of the rows that stand at `nodes`."""
    slot = np.full(max(int(node.max(initial=0)), *nodes) + 1, -1)
    slot[nodes] = np.arange(len(nodes))
    here = np.flatnonzero(slot[node] >= 0)
    n, f = len(nodes), bins.shape[1]
    first, own, each = slot[node[here]] * size, np.ascontiguousarray(bins[here].T), (g[here], h[here], None)
    out = np.empty((n, f, size, 3))
    for j in range(f):
        cell = first + own[j]
        for k, x in enumerate(each):
            out[:, j, :, k] = np.bincount(cell, x, minlength=n * size).reshape(n, size)
    return out


def loss(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight * np.logaddexp(0, np.where(label > 0.5, -margin, margin))


class Model:
    """Trees over binned features; cuts: each feature's cut points."""

    def __init__(self, features: list[str], cuts: list[list[float]], base: float, trees: list[Tree], losses: list[float]):
        self.features, self.cuts, self.base, self.trees, self.losses = list(features), cuts, base, trees, losses

    def table(self, spark) -> DataFrame:
        """One row: trees array<struct> of the nodes' columns with thresholds in the features' units."""
        rows = []
        for t in self.trees:
            threshold = [float(self.cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)]
            rows.append((t.feature, threshold, t.left, t.right, [float(v) for v in t.value], [float(c) for c in t.cover]))
        return spark.createDataFrame([(rows,)], f"trees {NUMBERS}")

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """df with its margin and the probability `out`; a null or absent feature counts as 0. Trees are walked for a batch of rows at a
        time, on bins: a value is in the bin of the first cut point that isn't below it, NaN in the last."""
        edges, base, trees = [np.array(c, np.float64) for c in self.cuts], float(self.base), self.trees

        @F.pandas_udf("double")
        def walked(*columns: pd.Series) -> pd.Series:
            bins = np.stack([np.searchsorted(e, x.to_numpy(np.float64), "left") for e, x in zip(edges, columns)], 1)
            margin = np.full(len(bins), base)
            for t in trees:
                margin += np.array(t.value)[t.place(bins)]
            return pd.Series(margin)

        x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in self.features]
        return df.withColumn("margin", walked(*x) if trees else F.lit(base)).withColumn(out, 1 / (1 + F.exp(-F.col("margin"))))


def _depth(t: Tree, node: int = 0) -> int:
    return 0 if t.feature[node] < 0 else 1 + max(_depth(t, t.left[node]), _depth(t, t.right[node]))


def cut_points(df: DataFrame, features) -> list[list[float]]:
    """At most BINS - 1 cut points a feature, from approximate quantiles; NULL and NaN count as 0."""
    filled = df.select(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
    found = filled.approxQuantile(list(features), [k / BINS for k in range(1, BINS)], 1 / (4 * BINS))
    return [sorted(set(q)) for q in found]


def binned(df: DataFrame, features, cuts, label: str, weight: str | None, validation: str | None) -> DataFrame:
    """-> key, label, weight, held (of the validation rows), bins (one byte a feature), margin 0."""
    edges = [np.array(c, np.float64) for c in cuts]

    def mapped(batches):
        for b in batches:
            at = np.stack([np.searchsorted(e, np.nan_to_num(np.asarray(b.column(4 + k).fill_null(0.0)), nan=0.0), "left") for k, e in enumerate(edges)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in at], pa.binary()), pa.array(np.zeros(b.num_rows))],
                                             names=["key", "label", "weight", "held", "bins", "margin"])

    names = [F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)]
    key = F.xxhash64(*names, F.col(label).cast("double"))
    held = F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    own = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    return df.where(F.col(label).isNotNull()).select(key.alias("key"), F.col(label).cast("double").alias("label"), own.alias("weight"), held.alias("held"), *names) \
        .mapInArrow(mapped, "key bigint, label double, weight double, held boolean, bins binary, margin double")


def _packed(batches):
    """A task's rows as one, each column's values end to end; there is no margin yet."""
    found = [[*(np.asarray(b.column(k)).tobytes() for k in (0, 1, 2)), b.column(3).to_numpy(zero_copy_only=False).tobytes(), b"".join(b.column(4).to_pylist())] for b in batches if b.num_rows]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary()) for x in (*zip(*found), ())], names=list(PACK))


def unpacked(block) -> list[np.ndarray]:
    """A block's columns; bins by row and feature."""
    found = [np.frombuffer(x, kind) for x, kind in zip(block, PACK.values())]
    found[4] = found[4].reshape(len(found[0]), -1)
    return found


def _blocks(batches, base: float, trees: list[Tree]):
    """Of each block its key, label, weight, held, bins, and margin after `trees`; a block without margins starts from the base."""
    for b in batches:
        for k in range(b.num_rows):
            key, label, weight, held, bins, margin = unpacked(b.column(c)[k].as_py() for c in range(len(PACK)))
            margin = margin.copy() if len(margin) else np.full(len(key), base)
            for t in trees:
                margin += np.array(t.value)[t.place(bins)]
            yield key, label, weight, held, bins, margin


def kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocked(rows: DataFrame, parts: int) -> DataFrame:
    """Binned rows as a saved table of at most `parts` blocks, a row each (PACK)."""
    return kept(rows.repartition(max(1, parts)).mapInArrow(_packed, ", ".join(f"{c} binary" for c in PACK)), "boosting-rows")


def fit(df: DataFrame, features, label: str, weight: str | None = None, validation: str | None = None, settings: Settings = Settings(), cuts: list[list[float]] | None = None) -> Model:
    """Trees on the rows of df that `validation` (a boolean column) doesn't mark; cuts: cut points to use in place of the rows' own.
    Rows without a label are left out; equal rows are
    drawn together. A table without rows, or of one class, gives a model without splits."""
    spark = df.sparkSession
    ensure_defaults(spark)
    features = list(features)
    fitting = df.where(~F.coalesce(F.col(validation).cast("boolean"), F.lit(False))) if validation else df
    cuts = cuts or cut_points(fitting, features)
    size = max((len(c) for c in cuts), default=0) + 1
    n = df.count()  # every pass reads these rows again: tasks of a size that is worth one, and one a core if there are enough rows
    parts = max(-(-n // TASK_ROWS), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    data = blocked(binned(df, features, cuts, label, weight, validation), parts)

    def weights(batches):
        for _, y, w, held, _, _ in _blocks(batches, 0.0, []):
            if not held.all():
                y, w = y[~held], w[~held]
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in ((w * y).sum(), (w * (1 - y)).sum())], names=["one", "zero"])

    sums = data.mapInArrow(weights, "one double, zero double").agg(F.sum("one"), F.sum("zero")).first()
    if not sums[0] or not sums[1]:
        return Model(features, cuts, 0.0 if sums[0] is None else math.copysign(20.0, (sums[0] or 0) - 1e-9), [], [])
    base = round(math.log(sums[0] / sums[1]), 9)
    trees, recent, losses, best = [], [], [], (math.inf, 0)
    cells = len(features) * size

    def passed(growth: Growth, nodes: list[int], number: int):
        sketch, settings_, recent_ = growth.sketch, settings, list(recent)

        def mapped(batches):
            total, lost = 0, 0.0
            for key, y, w, held, bins, margin in _blocks(batches, base, recent_):
                lost += np.rint(loss(margin[held], y[held], w[held]) * UNIT).sum()
                use = ~held & kept_share(key, settings_.rows, settings_.seed, number)
                g, h = slopes(margin[use], y[use], w[use])
                bins = bins[use]
                total = total + sums_by_bin(bins, g, h, sketch.place(bins), nodes, size)
            if not np.isscalar(total):
                flat = total.reshape(-1, 3)
                at = np.flatnonzero(flat[:, 2])
                names = ["cell", "g", "h", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[at, k].astype(np.int64)) for k in range(3))], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([-1]), *(pa.array([x]) for x in (int(lost), 0, 0))], names=names)

        each = data.mapInArrow(mapped, "cell bigint, g bigint, h bigint, n bigint")
        if parts > FEW:
            each = each.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        found = each.toArrow()
        cell, *columns = (np.asarray(found.column(k).combine_chunks()) for k in range(4))
        made = np.zeros((len(nodes) * cells, 3))
        own = cell >= 0
        for k, c in enumerate(columns):
            np.add.at(made[:, k], cell[own], c[own])
        return (made / np.array([UNIT, UNIT, 1.0])).reshape(len(nodes), len(features), size, 3), float(columns[0][~own].sum()) / UNIT

    for number in range(settings.rounds + 1):
        growth, first = Growth(settings, len(features), number), True
        while nodes := growth.light(growth.wanted()):
            made, lost = passed(growth, nodes, number)
            if first:  # the loss before this tree
                losses.append(lost)
                if lost < best[0] or not validation:
                    best = (lost, number)
                first = False
                if number == settings.rounds or validation and number - best[1] >= settings.patience:
                    return Model(features, cuts, base, trees[: best[1]], losses)
            growth.learn(made, nodes)
        tree = growth.tree()
        trees.append(tree)
        recent.append(tree)
        if len(recent) == KEEP:
            done = list(recent)

            def moved(batches):
                for block in _blocks(batches, base, done):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], names=list(PACK))

            data = kept(data.mapInArrow(moved, data.schema), "boosting-rows")
            recent.clear()
    raise AssertionError("unreachable")


def fit_blocks(blocks: list[tuple[np.ndarray, ...]], settings: Settings, size: int, start: list[Tree] = (), upto: int | None = None) -> list[Tree]:
    """The same trees from blocks (bins, key, label, weight) of all rows held in one place: a trial of the search (T10) in a task."""
    one, zero = (sum(float(x.sum()) for x in each) for each in zip(*((w * y, w * (1 - y)) for _, _, y, w in blocks)))
    base = round(math.log(one / zero), 9)
    margins, trees = [np.full(len(key), base) for _, key, _, _ in blocks], list(start)
    for (bins, *_), margin in zip(blocks, margins):
        for t in trees:
            margin += np.array(t.value)[t.place(bins)]
    for number in range(len(trees), settings.rounds if upto is None else min(upto, settings.rounds)):
        growth = Growth(settings, blocks[0][0].shape[1], number)
        drawn, asked = [], np.flatnonzero(growth.own)  # of each block the drawn rows' asked bins, gradients and hessians, and the nodes that they have come to
        growth.own = np.ones(len(asked), bool)
        for (bins, key, label, weight), margin in zip(blocks, margins):
            use = kept_share(key, settings.rows, settings.seed, number)
            drawn.append([bins[np.ix_(use, asked)], *slopes(margin[use], label[use], weight[use]), None])
        while nodes := growth.light(growth.wanted()):
            total = 0
            for own in drawn:
                own[3] = growth.sketch.place(own[0], own[3])
                total = total + sums_by_bin(*own, nodes, size)
            growth.learn(total / np.array([UNIT, UNIT, 1.0]), nodes)
        tree = growth.tree()
        tree.feature = [int(asked[f]) if f >= 0 else -1 for f in tree.feature]
        trees.append(tree)
        for (bins, *_), margin in zip(blocks, margins):
            margin += np.array(trees[-1].value)[trees[-1].place(bins)]
    return trees


def fit_rows(bins: np.ndarray, key: np.ndarray, label: np.ndarray, weight: np.ndarray, settings: Settings, size: int, start: list[Tree] = (), upto: int | None = None) -> list[Tree]:
    """The same trees from one block of rows: the twin that tests compare with."""
    return fit_blocks([(bins, key, label, weight)], settings, size, start, upto)
