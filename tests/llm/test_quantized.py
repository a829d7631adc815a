import math
import random

import numpy as np
import pytest

from retainly.llm import quantized
from retainly.llm.queries import OP11_SQL, QUERIES

from .helpers import SMALL, frame, rows_of

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, cosine=0.93):
    """rows (vec_id, embedding, label) -> the result, by comparing every pair."""
    sound = [label is not None and v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    x = [np.array(v, np.float64) if ok else None for (_, v, _), ok in zip(rows, sound)]
    x = [None if v is None else v / np.abs(v).max() for v in x]
    x = [None if v is None else v / np.linalg.norm(v) for v in x]
    near = [[j for j in range(len(rows)) if j != i and sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine] for i in range(len(rows))]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            for j in near[front.pop()]:
                if j not in seen:
                    seen.add(j)
                    front.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(near[i]), component, vec_id == component))
    return sorted(out, key=repr)


def invented(n, dims, seed, groups=10, labels=3):
    """Vectors all about, and groups whose members lie near the threshold of each other."""
    rng = np.random.default_rng(seed)
    rows = []
    middles = rng.normal(size=(groups, dims))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    for k in range(n):
        v = rng.normal(size=dims)
        if k % 2:
            v = middles[k % groups] + v / np.linalg.norm(v) * rng.uniform(0.05, 0.4)
        rows.append((k, [float(np.float32(c)) for c in v], int(k % groups % labels)))
    return rows


def found(spark, rows):
    return rows_of(quantized.near_duplicates(frame(spark, rows, SCHEMA)))


def test_equals_brute_force_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(QUERIES["op11_product_quantisation"](spark, SMALL)) == plain(rows)


def test_the_sql_says_the_same(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    assert sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({OP11_SQL})").fetchall(), key=repr) == rows_of(QUERIES["op11_product_quantisation"](spark, SMALL))


def test_recall_of_links_near_the_threshold(spark, monkeypatch):
    """Many lists and small blocks: at least 0.99 of the links of pairs with cosines from 0.9 up, and none that isn't one."""
    monkeypatch.setattr(quantized, "LIST", 40)
    monkeypatch.setattr(quantized, "BLOCK", 30)
    rows = invented(2400, 24, 5, groups=60)
    want, got = ({r[0]: r for r in f} for f in (plain(rows), found(spark, rows)))
    links = sum(r[1] for r in want.values())
    assert links > 10_000 and all(got[k][1] <= want[k][1] and got[k][2] >= want[k][2] for k in want)
    assert sum(r[1] for r in got.values()) >= 0.99 * links
    assert np.mean([got[k][2] == want[k][2] for k in want]) >= 0.98


def test_a_hot_list_is_cut_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(quantized, "BLOCK", 50)
    rng = np.random.default_rng(2)
    one = rng.normal(size=16)
    rows = [(k, [float(np.float32(c)) for c in one + rng.normal(size=16) * 0.02], 1) for k in range(400)] + invented(200, 16, 3)
    rows = [(k, v, label) for k, (_, v, label) in enumerate(rows)]
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = [(1, same, 1), (2, same, 1), (2, same, 1), (3, [2.0 * c for c in same], 1), (4, same, 2), (5, same, None), (6, None, 1), (7, [0.0] * 5, 1), (8, [1.0, None, 3.0, 4.0, 5.0], 1),
            (9, [nan, 2.0, 3.0, 4.0, 5.0], 1), (10, [inf, 2.0, 3.0, 4.0, 5.0], 1), (11, [], 1), (12, same[:4], 1), (13, same[:4], 1), (None, same, 1), (None, [5.0, -1.0, 0.0, 0.0, 1.0], 1),
            (14, [1e-40 * c for c in same], 1), (15, [-c for c in same], 1), (-3, [3e38, 0.0, 0.0, 0.0, 0.0], 1), (16, [1.0, 0.0, 0.0, 0.0, 0.0], 1), (None, None, None)]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    docs = frame(spark, [(*r, 1, "x", 2.0, 3) for r in rows], SCHEMA + ", node bigint, list string, copies double, side int")
    got = quantized.near_duplicates(docs)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = plain(rows)
    assert rows_of(got) == [(r[0], r[1], r[2], r[0] == r[2]) for r in want]
    assert rows_of(quantized.near_duplicates(docs.limit(0))) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_looked_up_bounds_hold(seed):
    """No pair over the threshold is ruled out by codes, however coarse they are."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(600, 10)) + rng.normal(size=(6, 10))[rng.integers(6, size=600)] * 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = quantized.Model(x[:200], 5000, 0.93)
    own, visits, codes, left = model.encode(x.copy())
    assert all(o in v for o, v in zip(own, visits))
    may = model.candidates(x, own, codes, left)
    assert not ((x @ x.T >= 0.93) & ~may).any() and may.mean() < 0.9


def test_spanning_links_connect_all_that_is_linked():
    rng = np.random.default_rng(4)
    for _ in range(50):
        near = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.choice([0.05, 0.2, 0.6])

        def parts(pairs):
            name = {**{("r", i): ("r", i) for i in range(near.shape[0])}, **{("c", j): ("c", j) for j in range(near.shape[1])}}
            for _ in range(30):
                for i, j in pairs:
                    name["r", i] = name["c", j] = min(name["r", i], name["c", j])
            return name

        made = quantized._spanning(near)
        assert all(near[i, j] for i, j in made) and len(made) < sum(near.shape)
        assert parts(made) == parts(list(zip(*np.nonzero(near))))


def test_random_order_changes_nothing(spark):
    rows = invented(150, 12, 9)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert found(spark, rows) == found(spark, shuffled) == plain(rows)
