"""Leaf-wise boosting against its single-machine twin and scikit-free rules; tree attributions against the sum over all subsets."""

import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainly.operators import attribution as A
from retainly.operators import boosting as B
from retainly.operators import train as TR

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1000).select(
        "id", F.randn(1).alias("a"), F.randn(2).alias("b"), F.round(F.rand(3) * 5).alias("c"), F.when(F.rand(4) < 0.9, F.rand(5)).alias("d"), F.rand(6).alias("u"))
    signal = F.col("a") * F.col("b") + (F.col("c") > 2).cast("int") - 0.5 + F.coalesce("d", F.lit(0.0))
    df = df.withColumn("label", (F.col("u") < 1 / (1 + F.exp(-2 * signal))).cast("double")).withColumn("weight", F.when(F.col("label") == 1, 0.8).otherwise(1.3))
    return df.withColumn("held", F.col("id") % 5 == 0).repartition(7).cache()


def local(rows, model, settings):
    found = B.binned(rows.where("not held"), FEATURES, model.cuts, "label", "weight", None).toPandas()
    bins = np.stack([np.frombuffer(b, np.uint8) for b in found.bins])
    return B.fit_rows(bins, found.key.to_numpy(), found.label.to_numpy(), found.weight.to_numpy(), settings, max(map(len, model.cuts)) + 1)


def test_trees_equal_the_single_machine_twin(rows, monkeypatch):
    settings = B.Settings(rounds=13, leaves=9, child_rows=5, child_weight=0.5, seed=3)
    model = B.fit(rows.where("not held"), FEATURES, "label", "weight", None, settings)
    assert model.trees == local(rows, model, settings) and len(model.trees) == 13
    monkeypatch.setattr(B, "TASK_ROWS", 150)  # other tasks, other order
    again = B.fit(rows.where("not held").orderBy("a"), FEATURES, "label", "weight", None, replace(settings, rounds=3), model.cuts)
    assert again.trees == model.trees[:3]


def test_best_leaf_first(rows):
    """Splits by brute force: each time the leaf that gains most, until the leaves are used up."""
    settings = B.Settings(rounds=1, leaves=6, rows=1.0, columns=1.0, child_rows=20, l2=1.0)
    model = B.fit(rows.where("not held"), FEATURES, "label", "weight", None, settings)
    found = B.binned(rows.where("not held"), FEATURES, model.cuts, "label", "weight", None).toPandas()
    bins = np.stack([np.frombuffer(b, np.uint8) for b in found.bins])
    g, h = B.slopes(np.full(len(found), model.base), found.label.to_numpy(), found.weight.to_numpy())
    g, h = g / B.UNIT, h / B.UNIT

    def best(own):
        top = (0.0, None)
        for f in range(4):
            for cut in range(64):
                low = own & (bins[:, f] <= cut)
                high = own & ~low
                if min(low.sum(), high.sum()) >= 20:
                    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
                    gain = score(low) + score(high) - score(own)
                    if gain > top[0] + 1e-9:
                        top = (gain, (low, high))
        return top

    leaves = [np.ones(len(found), bool)]
    while len(leaves) < 6:
        k = max(range(len(leaves)), key=lambda i: best(leaves[i])[0])
        leaves[k : k + 1] = best(leaves[k])[1]
    want = sorted((int(m.sum()), round(-0.1 * g[m].sum() / (h[m].sum() + 1.0), 9)) for m in leaves)
    t = model.trees[0]
    at = t.place(bins)
    assert sorted((int((at == n).sum()), round(t.value[n], 9)) for n in set(at.tolist())) == want


def test_settings_hold(rows):
    model = B.fit(rows, FEATURES, "label", "weight", "held", B.Settings(rounds=6, leaves=40, depth=3, columns=0.5, child_rows=30, child_weight=4.0))
    asked = [{f for f in t.feature if f >= 0} for t in model.trees]
    assert all(B._depth(t) <= 3 for t in model.trees) and len({frozenset(a) for a in asked}) > 1 and min(map(len, asked)) < 4
    assert all(c >= 4.0 for t in model.trees for c in t.cover)


def test_early_stopping_keeps_the_best_round(rows):
    model = B.fit(rows, FEATURES, "label", "weight", "held", B.Settings(rounds=60, leaves=15, rate=0.5, patience=4))
    assert len(model.trees) == int(np.argmin(model.losses)) and len(model.losses) == len(model.trees) + 5
    assert model.losses[len(model.trees)] < 0.95 * model.losses[0]


def test_score_walks_the_trees(rows):
    model = B.fit(rows, FEATURES, "label", "weight", "held", B.Settings(rounds=12, leaves=8, patience=12))
    scored = model.score(rows).toPandas()
    x = scored[FEATURES].fillna(0.0).to_numpy()
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(model.cuts)], 1)
    want = model.base + sum(np.array(t.value)[t.place(bins)] for t in model.trees)
    assert np.allclose(scored.margin, want, atol=1e-12) and np.allclose(scored.p, 1 / (1 + np.exp(-want)))
    assert TR.curve_metrics(model.score(rows.where("held")), "label", "p").first().roc_auc > 0.7


def test_tables_without_a_signal(spark, rows):
    one = B.fit(rows.withColumn("label", F.lit(1.0)), FEATURES, "label")
    assert one.trees == [] and all(r.p > 0.99 for r in one.score(rows.limit(5)).collect())
    assert B.fit(rows.limit(0), FEATURES, "label").trees == []
    flat = B.fit(rows.select("label", *(F.lit(1.0).alias(f) for f in FEATURES)), FEATURES, "label", settings=B.Settings(rounds=2))
    assert [t.feature for t in flat.trees] == [[-1], [-1]]


def shapley(leaves, x, n):
    """The sum over all subsets, as Shapley values are defined."""
    def worth(known):
        return sum(v * math.prod(float(lo < x[f] <= hi) if f in known else z for f, lo, hi, z in conditions) for _, v, conditions in leaves)

    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (worth({*s, i}) - worth(set(s))) for k in range(n) for s in itertools.combinations(rest, k)))
    return out


def test_attributions_of_sparks_trees_equal_the_sum_over_subsets(spark, rows):
    est = TR.GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxDepth=3, maxIter=8, seed=1)
    filled = rows.fillna(0.0)
    model = TR.pipeline(FEATURES, est).fit(filled)
    leaves = A.leaf_table(spark, model)
    got = {r.id: r.attributions for r in A.attributions(filled, leaves, FEATURES, "id").collect()}
    base = A.expected_margin(leaves)
    scored = TR.probability(model.transform(filled)).select("id", *FEATURES, "p").collect()
    assert len(got) == len(scored) == 1000
    for k, r in enumerate(scored):
        margin = base + sum(got[r.id].values())
        assert 1 / (1 + math.exp(-2 * margin)) == pytest.approx(r.p, abs=1e-9)
        if k < 25:
            assert [got[r.id][f] for f in FEATURES] == pytest.approx(shapley(leaves, [r[f] for f in FEATURES], 4), abs=1e-9)


def test_attributions_of_leafwise_trees_add_up(spark, rows):
    model = B.fit(rows, FEATURES, "label", "weight", "held", B.Settings(rounds=10, leaves=12, patience=10))
    leaves = A.leaf_table(spark, model)
    found = A.attributions(rows, leaves, FEATURES, "id")
    base = A.expected_margin(leaves, model.base)
    for r in model.score(rows).join(found, "id").collect():
        assert base + sum(r.attributions.values()) == pytest.approx(r.margin, abs=1e-9)
    top = A.explained(rows.select("id", *FEATURES), found, "id", 2).where("id = 7").first().explanation
    own = sorted(found.where("id = 7").first().attributions.items(), key=lambda e: (-abs(e[1]), e[0]))[:2]
    assert [(e.feature, e.contribution) for e in top] == own


def test_attributions_without_trees(spark, rows):
    got = A.attributions(rows.limit(3), [], FEATURES, "id").collect()
    assert [set(r.attributions.values()) for r in got] == [{0.0}] * 3


def test_one_of_two_siblings_is_added_up(rows, monkeypatch):
    model = B.fit(rows.where("not held"), FEATURES, "label", "weight", None, B.Settings(rounds=1, leaves=9))
    asked, summed = [], B.sums_by_bin
    monkeypatch.setattr(B, "sums_by_bin", lambda bins, g, h, at, nodes, size: asked.append((len(nodes), int(np.isin(at, nodes).sum()))) or summed(bins, g, h, at, nodes, size))
    trees = local(rows, model, B.Settings(rounds=1, leaves=9))
    assert trees == model.trees
    assert all(2 * n <= asked[0][1] for _, n in asked[1:])  # of each generation's rows no more than half


def test_rows_are_kept_in_blocks(rows, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 150)
    made, kept = [], B.kept
    monkeypatch.setattr(B, "kept", lambda df, name: made.append(kept(df, name)) or made[-1])
    B.fit(rows, FEATURES, "label", "weight", "held", B.Settings(rounds=11, leaves=3, patience=11))
    assert [df.count() for df in made] == [7, 7]


def test_shares_by_table_and_by_row_agree(monkeypatch):
    rng = np.random.default_rng(5)
    leaves = [(0, rng.normal(), [(f, *sorted(rng.normal(size=2).tolist()), rng.uniform(0.1, 0.9)) for f in sorted(rng.choice(12, m, replace=False).tolist())]) for m in (0, 1, 3, 9, 12)]
    x = rng.normal(size=(12, 300))
    x[2, :5] = np.nan
    one = A.added(x, leaves, {})
    monkeypatch.setattr(A, "PATTERNS", 0)
    assert np.allclose(one, A.added(x, leaves, {}), atol=1e-12)
    short = [leaf for leaf in leaves if len(leaf[2]) <= 3]
    few = sorted({c[0] for _, _, conditions in short for c in conditions})
    got, at = A.added(x, short, {}), {f: k for k, f in enumerate(few)}
    own = [(k, v, [(at[f], lo, hi, z) for f, lo, hi, z in conditions]) for k, v, conditions in short]
    for r in (0, 7, 100):
        assert got[few, r].tolist() == pytest.approx(shapley(own, x[few, r].tolist(), len(few)), abs=1e-9)


def test_attributions_move_one_row_for_a_row(spark, rows):
    leaves = [(0, 1.0, [(0, -math.inf, 0.0, 0.5)]), (0, -1.0, [(0, 0.0, math.inf, 0.5)])]
    plan = A.attributions(rows, leaves, FEATURES, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Explode" not in plan
    twice = A.attributions(rows.where("id = 3").union(rows.where("id = 3")).union(rows.where("id = 4").withColumn("id", F.lit(None).cast("bigint"))), leaves, FEATURES, "id")
    assert sorted(abs(r.attributions["a"]) for r in twice.collect()) == [0.0, 2.0, 2.0]  # rows of one key count together, a null key has none
