"""Learned category affinity."""

import random
from collections import defaultdict

import numpy as np
import pytest

from retainly.operators import affinity as AF

SCHEMA = "customer_id bigint, category string, n bigint"


def tastes(rng, customers=240, groups=4, each=10):
    """Customers who buy most categories of their group and a stray one of another."""
    rows = []
    for c in range(customers):
        own = [f"g{c % groups}-{k}" for k in rng.sample(range(each), each - 4)]
        stray = f"g{rng.randrange(groups)}-{rng.randrange(each)}"
        rows += [(c, x, rng.randint(1, 4)) for x in {*own, stray}]
    return rows


@pytest.fixture(scope="module")
def prefs(spark):
    return spark.createDataFrame(tastes(random.Random(3)), SCHEMA)


def test_learned_vectors_rank_held_out_categories_above_the_share_vector(prefs):
    got = {r.method: r for r in AF.holdout_ranking(prefs).collect()}
    assert got["learned"].customers == 240
    assert got["share"].auc == pytest.approx(0.5)
    assert got["learned"].auc > 0.8 > got["popularity"].auc


def test_the_ranking_equals_a_count_by_hand(spark, prefs, monkeypatch):
    monkeypatch.setattr(AF, "BLOCK", 7)  # several passes
    got = {r.method: r.auc for r in AF.holdout_ranking(prefs).collect()}
    sold, bought, held = defaultdict(float), defaultdict(set), {}
    for r in AF.held_out(prefs).collect():
        bought[r.customer_id].add(r.category)
        if r.held:
            held[r.customer_id] = r.category
        else:
            sold[r.category] += r.n
    every = set().union(*bought.values())
    shares = []
    for c, mine in held.items():
        others = every - bought[c]
        shares.append(sum(1.0 if sold[x] < sold[mine] else 0.5 if sold[x] == sold[mine] else 0.0 for x in others) / len(others))
    assert got["popularity"] == pytest.approx(np.mean(shares))


def test_the_same_seed_gives_the_same_vectors_and_the_best_categories(prefs, monkeypatch):
    monkeypatch.setattr(AF, "BLOCK", 9)
    runs = []
    for rows in (prefs, prefs.repartition(5, "category")):
        customers, categories = AF.fit(rows, AF.numbered(rows))
        runs.append(({r.customer_id: np.array(r.vector) for r in customers.collect()}, {r.category: np.array(r.vector) for r in categories.collect()}, AF.affinities(customers, categories).collect()))
    (u, v, best), (u2, v2, _) = runs
    assert all(np.allclose(u[c] @ v["g0-1"], u2[c] @ v2["g0-1"], atol=1e-3) for c in u)
    assert len(best) == 240 and all(len(r.top) == 3 for r in best)
    for r in best[:40]:
        want = sorted((-(u[r.customer_id].astype(float) @ x.astype(float)), c) for c, x in v.items())[:3]
        assert [a.category for a in r.top] == [c for _, c in want]
        assert [a.affinity for a in r.top] == pytest.approx([-a for a, _ in want])


def test_items_are_numbered_in_order(prefs):
    rows = AF.numbered(prefs).orderBy("item").collect()
    assert [r.item for r in rows] == list(range(len(rows)))
    assert [r.category for r in rows] == sorted(r.category for r in rows)


def test_empty_single_and_wide_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    customers, categories = AF.fit(none, AF.numbered(none))
    assert AF.affinities(customers, categories).count() == 0 and AF.holdout_ranking(none).count() == 0
    one = spark.createDataFrame([(1, "a", 2), (2, "a", 1)], SCHEMA)  # nobody has a second category
    customers, categories = AF.fit(one, AF.numbered(one))
    assert {tuple(a.category for a in r.top) for r in AF.affinities(customers, categories).collect()} == {("a",)}
    assert {r.customers for r in AF.holdout_ranking(one).collect()} <= {0}
    wide = spark.createDataFrame([(2**40, "a", 2)], SCHEMA)
    with pytest.raises(ValueError, match="32 bits"):
        AF.fit(wide, AF.numbered(wide))
