"""The global-order primitive against brute force / pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retainly.operators.evaluate import curve_metrics
from retainly.operators.ordered import exact_quantiles, ordered_prefix, rank_first, value_ranks
from retainly.operators.rfm import rfm_scores


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "k": rng.integers(0, 3, n),
                        "v": rng.integers(0, 50, n).astype(float)})
    pdf.loc[pdf.id < n // 3, "v"] = 11.0  # a value holding a third of all rows
    return pdf, spark.createDataFrame(pdf)


def test_ordered_prefix_matches_cumsum(data):
    pdf, df = data
    d = df.withColumn("one", F.lit(1).cast("bigint"))
    got = ordered_prefix(d, "v", ["one"], ["k"], n_buckets=8).toPandas().sort_values(["k", "v"])
    exp = pdf.groupby(["k", "v"]).size().rename("one").reset_index().sort_values(["k", "v"])
    exp["below"] = exp.groupby("k").one.cumsum() - exp.one
    assert (got.one_below.values == exp.below.values).all()
    assert (got.one_total.values == exp.groupby("k").one.transform("sum").values).all()


def test_exact_quantiles_match_numpy(data):
    pdf, df = data
    q = exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.9, 1.0]).first()
    exp = np.percentile(pdf.v, [10, 25, 50, 90, 100])
    assert np.allclose([q[f"q_{i}"] for i in range(5)], exp)


def test_rank_first_and_min_rank(data):
    pdf, df = data
    r = rank_first(df, "v", "id").toPandas().sort_values("id")
    assert (r._rank.values == pdf.v.rank(method="first").astype(int).values).all()
    vr = value_ranks(df, "v").toPandas().set_index("v")
    mr = pdf.groupby("v").v.size().cumsum().shift(fill_value=0)
    assert (vr.loc[mr.index, "_below"].values == mr.values).all()


def test_qcut_semantics(spark):
    """f_score follows qcut on first-ranks: 7 ranks -> 1,1,2,3,4,5,5."""
    import datetime as dt
    rows = [(i, i, dt.datetime(2024, 1, 1), 10.0 * (i + 1)) for i in range(7)]
    tx = spark.createDataFrame(rows, "transaction_id long, customer_id long, order_date timestamp_ntz, order_amount double")
    # frequency = one order each -> ranks by customer id
    r = rfm_scores(tx, "2024-01-11 00:00:00").orderBy("customer_id").collect()
    assert [x["f_score"] for x in r] == [1, 1, 2, 3, 4, 5, 5]
    assert [x["m_score"] for x in r] == list(pd.qcut([10.0 * (i + 1) for i in range(7)], 5, labels=[1, 2, 3, 4, 5]).astype(int))


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def _brute_pr_auc(y, s):
    order = np.argsort(-s, kind="mergesort")
    ys, ss = y[order], s[order]
    thresholds = np.unique(ss)[::-1]
    P = ys.sum()
    pts = [(0.0, 1.0)]
    for t in thresholds:
        tp = ys[ss >= t].sum()
        fp = (ss >= t).sum() - tp
        pts.append((tp / P, tp / (tp + fp)))
    return sum((r1 - r0) * (p1 + p0) / 2 for (r0, p0), (r1, p1) in zip(pts, pts[1:]))


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 800)
    s = np.round(rng.random(800) * 0.6 + y * 0.3, 2)  # ties on purpose
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    r = curve_metrics(df, "y", "s").first()
    assert abs(r["roc_auc"] - _brute_auc(y, s)) < 1e-6
    assert abs(r["pr_auc"] - _brute_pr_auc(y, s)) < 1e-6
    # invariant under a monotone map of the score
    r2 = curve_metrics(df.withColumn("s", F.col("s") * 3 + 1), "y", "s").first()
    assert r2["roc_auc"] == r["roc_auc"] and r2["pr_auc"] == r["pr_auc"]


def test_plan_has_no_single_task_window_over_rows(data):
    """Plan test: the running window is partitioned by (keys, bucket); the
    only SinglePartition exchange sits over the per-bucket table (<= 64 rows)."""
    _, df = data
    plan = value_ranks(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan
    assert plan.count("SinglePartition") <= 1
    from retainly.operators.ordered import quantile_splits
    assert len(quantile_splits(df, "v", 64)) <= 63


def test_many_buckets_use_binary_search(data):
    """Above CASE_TREE_MAX splits the bucket index comes from a binary search
    over a literal split array (shared and per-key); results stay exact."""
    from retainly.operators.ordered import CASE_TREE_MAX, bucket_expr, keyed_bucket_expr
    pdf, df = data
    d = df.withColumn("one", F.lit(1).cast("bigint"))
    nb = 4 * CASE_TREE_MAX
    got = ordered_prefix(d, "v", ["one"], ["k"], n_buckets=nb).toPandas().sort_values(["k", "v"])
    exp = pdf.groupby(["k", "v"]).size().rename("one").reset_index().sort_values(["k", "v"])
    exp["below"] = exp.groupby("k").one.cumsum() - exp.one
    assert (got.one_below.values == exp.below.values).all()
    splits = [float(x) / 3 for x in range(1, 3 * CASE_TREE_MAX)]
    keyed = {0: splits, 1: splits[::2], 2: splits[:5]}
    out = df.select("k", "v", bucket_expr(F.col("v"), splits).alias("b"),
                    keyed_bucket_expr(F.col("v"), keyed, ["k"]).alias("kb")).toPandas()
    assert (out.b.values == np.searchsorted(splits, out.v.values, side="right")).all()
    exp_kb = [np.searchsorted(keyed[k], v, side="right") for k, v in zip(out.k, out.v)]
    assert (out.kb.values == np.array(exp_kb)).all()


def test_forward_fill_hot_tied_timestamp(spark):
    """A key whose rows mostly share ONE timestamp (ordered by id within it):
    the tie gets its own chunk, sub-chunked by id; the fill still equals a
    sequential pandas ffill / shift over (ts, id)."""
    import datetime as dt
    from retainly.operators.ordered import forward_fill
    rng = np.random.default_rng(3)
    n = 2000
    base = dt.datetime(2024, 1, 1)
    ts = [base + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 5000, n)]
    key = rng.integers(0, 4, n)
    hot = np.arange(n) < n // 2          # half of all rows: key 0, one instant
    key[hot] = 0
    ts = [base + dt.timedelta(minutes=2500) if h else t for h, t in zip(hot, ts)]
    val = np.where(rng.random(n) < 0.4, np.nan, rng.integers(0, 100, n).astype(float))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "ts": ts, "x": val})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")) \
        .withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    got = forward_fill(df, ["x"], "k", ["ts", "id"], n_chunks=8).toPandas().set_index("id").sort_index()
    lag = forward_fill(df, ["x"], "k", ["ts", "id"], n_chunks=8, include_current=False) \
        .toPandas().set_index("id").sort_index()
    s = pdf.sort_values(["k", "ts", "id"])
    exp = s.groupby("k").x.ffill()
    exp_prev = s.assign(f=exp).groupby("k").f.shift(1)
    assert np.allclose(got.x.loc[exp.index].values, exp.values, equal_nan=True)
    assert np.allclose(lag.prev_x.loc[exp_prev.index].values, exp_prev.values, equal_nan=True)


def test_with_bucket_paths_agree(spark):
    """Bucketizer (long shared lists), CASE tree (short) and array search give
    the number of splits <= v; NULL -> 0."""
    from retainly.operators.ordered import CASE_TREE_MAX, bucket_expr, with_bucket
    vals = [None, -5.0, 0.0, 0.5, 1.0, 3.3, 99.0, 1e9]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for n in (5, 3 * CASE_TREE_MAX):
        splits = [i / 10 for i in range(n)]
        got = with_bucket(df, F.col("v"), splits, "b").withColumn("e", bucket_expr(F.col("v"), splits)).collect()
        for r in got:
            exp = 0 if r["v"] is None else int(np.searchsorted(splits, r["v"], side="right"))
            assert r["b"] == exp and (r["v"] is None or r["e"] == exp)


def test_a_value_with_most_rows_is_not_one_task(spark):
    """70 % of the rows on one value, without AQE's skew join: its rows are never shuffled by value."""
    from pyspark.sql import functions as F

    from retainly.operators import ordered as O
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 < 7, 0.0).otherwise(F.col("id") * 1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        got = {r.id: r.v_pr for r in O.percent_ranks(df, "id", ["v"], n_buckets=8).collect()}
        table = O.value_ranks(df, "v", n_buckets=8)
        plan = O.join_by_value(df, table, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert "strategy=broadcast" in plan and "LeftAnti" in plan
    values = sorted(0.0 if i % 10 < 7 else float(i) for i in range(2000))
    first = {v: values.index(v) for v in set(values)}
    assert all(abs(got[i] - first[0.0 if i % 10 < 7 else float(i)] / 1999) < 1e-12 for i in range(2000))


def test_rank_first_carries_the_columns_without_joining_rows_back(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), int(v), f"name {i}") for i, v in enumerate(rng.integers(0, 6, 300))] + [(1000, None, "none")]
    df = spark.createDataFrame(rows, "id long, v long, name string")
    got = rank_first(df, "v", "id", n_buckets=4)
    want = {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v, _ in rows if v is not None))}
    assert {r.id: r._rank for r in got.collect()} == want
    assert all(r.name == f"name {r.id}" and r._n == 300 for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # rows meet tables of buckets and of values, never a table of rows: the tie is in no join condition
    assert not [x for x in plan.splitlines() if "Join" in x and "id#" in x.split("Join", 1)[1]]


def test_feature_statistics_reads_its_input_once(spark):
    from retainly.operators import quality as Q
    from retainly.plans.cleaning import Z_COLS
    from retainly.operators.transactions import transaction_features
    from retainly.sources import views as V
    from retainly.sources.tables import Tables
    features = transaction_features(V.transactions(Tables(spark, "/root/testdata/sf0.001")), V.ORDERS_AS_OF)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey")
    assert scans(features) > 0
    got = Q.feature_statistics(features, Z_COLS)
    assert scans(got) == 0 and {r.column_name for r in got.collect()} == set(Z_COLS)
