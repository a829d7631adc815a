"""Shapley values of boosted trees along their paths.

A leaf pays its value to the rows that meet all conditions on its path; a
feature that is left out lets a share z of the rows through: the cover of the
node it leads to over that of the node it is asked at, multiplied up where it is
asked more than once. With o = 1 for a met condition and 0 for another, feature
i of a leaf of value v gets

    v (o_i - z_i)  integral over t in [0, 1] of  prod_{j <> i} ((1 - t) z_j + t o_j),

as |S|! (m - |S| - 1)! / m! is the integral of t^|S| (1 - t)^(m - |S| - 1). The
product is a polynomial in t, so a Gauss-Legendre rule of m / 2 points is exact.

The model is a list of leaves, as many as the fitted trees have, whatever the
data. A task takes its rows a batch at a time and adds up what each leaf pays to
all of them; of a leaf with up to PATTERNS conditions this is worked out once for
each way of meeting them, and rows look it up. One row with a number for each
feature comes of a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .boosting import Model, Tree

PATTERNS = 10  # conditions of a leaf whose ways of being met, 2 to that power at most, are worked out first


def _leaves(number: int, feature, threshold, left, right, value, cover) -> list[tuple]:
    """The leaves of a tree given by its nodes' columns, with one condition for each feature on the path."""
    found, walk = [], [(0, {})]
    while walk:
        node, path = walk.pop()
        if feature[node] < 0:
            found.append((number, float(value[node]), [(f, lo, hi, z) for f, (lo, hi, z) in sorted(path.items())]))
            continue
        f, cut = int(feature[node]), float(threshold[node])
        lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left[node], (lo, min(hi, cut))), (right[node], (max(lo, cut), hi))):
            walk.append((child, {**path, f: (*map(float, bounds), float(z * cover[child] / cover[node]))}))
    return found


def leaf_table(spark, model) -> list[tuple]:
    """Rows (tree, value, conditions) of a leaf-wise Model or of a fitted pipeline or model of Spark's boosted trees; values of the
    latter are in units of its margin, whose probability is 1 / (1 + exp(-2 margin))."""
    if isinstance(model, Model):
        def columns(t: Tree):
            return t.feature, [model.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)], t.left, t.right, t.value, t.cover
        return [leaf for k, t in enumerate(model.trees) for leaf in _leaves(k, *columns(t))]
    boosted = model.stages[-1] if hasattr(model, "stages") else model
    path = scratch_path(spark, "boosted-trees")
    boosted.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # the fitted trees
    trees: dict[int, dict] = {}
    for n in nodes:
        trees.setdefault(n.treeID, {})[n.id] = n
    found = []
    for k in sorted(trees):
        t = [trees[k][i] for i in range(len(trees[k]))]
        feature = [n.split.featureIndex if n.leftChild >= 0 else -1 for n in t]
        if any(n.leftChild >= 0 and n.split.numCategories != -1 for n in t):
            raise ValueError("attributions are for trees of continuous features")
        weight = boosted.treeWeights[k]
        found += _leaves(k, feature, [n.split.leftCategoriesOrThreshold[0] if n.leftChild >= 0 else 0.0 for n in t], [n.leftChild for n in t], [n.rightChild for n in t],
                         [n.prediction * weight for n in t], [n.impurityStats[0] for n in t])
    return found


def expected_margin(leaves: list[tuple], start: float = 0.0) -> float:
    """The margin that is left when no feature is known."""
    return start + sum(value * float(np.prod([c[3] for c in conditions])) for _, value, conditions in leaves)


def paid(value: float, z: np.ndarray, met: np.ndarray) -> np.ndarray:
    """What a leaf pays: met (conditions, rows) -> shares (conditions, rows)."""
    z, o, total = z[:, None], met.astype(np.float64), np.zeros(met.shape)
    for p, w in zip(*np.polynomial.legendre.leggauss((len(z) + 1) // 2)):
        through = (1 - (p + 1) / 2) * z + (p + 1) / 2 * o
        total += w / 2 * (through.prod(0) / through)
    return value * (o - z) * total


def added(x: np.ndarray, leaves: list[tuple], tables: dict) -> np.ndarray:
    """x (features, rows) -> shares (features, rows) of all leaves; tables: keeps what was worked out for a leaf."""
    out = np.zeros(x.shape)
    for k, (_, value, conditions) in enumerate(leaves):
        if not conditions:
            continue
        at, low, high, z = (np.array(c) for c in zip(*conditions))
        met = (x[at] > low[:, None]) & (x[at] <= high[:, None])
        if len(at) > PATTERNS:
            out[at] += paid(value, z, met)
            continue
        bit = np.arange(len(at))[:, None]
        if k not in tables:
            tables[k] = paid(value, z, np.arange(2 ** len(at)) >> bit & 1)
        out[at] += tables[k][:, (met << bit).sum(0)]
    return out


def attributions(df: DataFrame, leaves: list[tuple], features, key: str) -> DataFrame:
    """df (key unique, features...) -> key, attributions: map of feature to its share of the margin over the expected one. Features
    that are null or absent count as 0; ones that no tree asks for have share 0."""
    features = list(features)
    x = [(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)]
    rows = df.select(F.col(key).alias("row"), *x)
    names = [f"s{k}" for k in range(len(features))]

    def mapped(batches):
        tables: dict = {}
        for b in batches:
            shares = added(np.stack([np.asarray(c) for c in b.columns[1:]]), leaves, tables)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, shares)], names=["row", *names])

    each = rows.mapInArrow(mapped, f"row {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names))
    gathered = each.groupBy("row").agg(*(F.sum(c).alias(c) for c in names))
    filled = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*(F.coalesce(c, F.lit(0.0)) for c in names)))
    return df.select(F.col(key).alias("row")).join(gathered, "row", "left").select(F.col("row").alias(key), filled.alias("attributions"))


def explained(df: DataFrame, found: DataFrame, key: str, top: int = 5, out: str = "explanation") -> DataFrame:
    """df with the `top` features by absolute attribution, ties by name: array of (feature, contribution, value)."""
    def largest(a, b):
        x, y = F.abs(a["contribution"]), F.abs(b["contribution"])
        return F.when(x > y, -1).when(x < y, 1).when(a["feature"] < b["feature"], -1).otherwise(1)

    names = [c for c in df.columns if c != key]
    values = F.create_map(*(x for c in names if dict(df.dtypes)[c] in ("double", "float", "int", "bigint") for x in (F.lit(c), F.col(c).cast("double"))))
    items = F.transform(F.map_entries("attributions"), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("contribution"), F.try_element_at("_values", e["key"]).alias("value")))
    joined = df.withColumn("_values", values).join(found, key, "left")
    return joined.withColumn(out, F.slice(F.array_sort(items, largest), 1, top)).drop("_values", "attributions")
