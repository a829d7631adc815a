"""Sketches by day and the incremental feature state, against rebuilds from all rows."""

import os

import numpy as np
from pyspark.sql import functions as F

from retainly.operators import daystate as DY
from retainly.operators import sketches as SK

METHODS = ["a", "b", "c", "other"]


def events(spark, n=6000):
    day = F.make_dt_interval(F.col("id") % 40, F.col("id") % 24)
    return spark.range(n).select((F.lit("2024-01-01").cast("timestamp") + day).alias("ts"), (F.randn(3) * 10 + F.col("id") % 40).alias("x"),
                                 F.when(F.col("id") % 9 > 0, F.exp(F.randn(4))).when(F.col("id") % 2 == 0, F.lit(float("nan"))).alias("y"))


def ranks(values, got, p):
    """How far the rank of a value is from p."""
    below, upto = (values < got).mean(), (values <= got).mean()
    return max(0.0, below - p, p - upto)


def test_windows_are_within_the_rank_error(spark, tmp_path):
    df = events(spark).cache()
    path = str(tmp_path / "s")
    SK.store_sketches(SK.daily_sketches(df, "ts", ["x", "y"]), path)
    rows = df.toPandas()
    rows["day"] = rows.ts.dt.normalize()
    found = SK.windows(SK.read_sketches(spark, path), 30).collect()
    assert {r.feature for r in found} == {"x", "y"} and len({r.window_start for r in found}) == 69
    for r in found[::5]:
        at = np.datetime64(r.window_start)
        v = rows.loc[(rows.day >= at) & (rows.day < at + np.timedelta64(30, "D")), r.feature].dropna().to_numpy()
        assert (r.n, r.least, r.largest) == (len(v), v.min(), v.max())
        assert all(ranks(v, got, p) <= SK.RANK_ERROR + 1 / len(v) for got, p in ((r.q25, 0.25), (r.q50, 0.5), (r.q75, 0.75)))


def test_a_window_reads_no_event_rows_and_a_day_is_replaced(spark, tmp_path):
    path = str(tmp_path / "s")
    df = events(spark)
    SK.store_sketches(SK.daily_sketches(df, "ts", ["x"]), path)
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    fixed = df.where("ts >= '2024-01-05' and ts < '2024-01-06'").withColumn("x", F.lit(5000.0))
    SK.store_sketches(SK.daily_sketches(fixed, "ts", ["x"]), path)
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    assert {d for d in before if before[d] != after[d]} == {"day=2024-01-05"}
    window = SK.merged(SK.read_sketches(spark, path, "2024-01-03", "2024-01-12"))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(day" in plan and "ts" not in window.columns
    assert window.first().largest == 5000.0 and window.first().n == df.where("ts >= '2024-01-03' and ts < '2024-01-13'").count()


def test_drift_from_sketches(spark, tmp_path):
    df = events(spark, 20_000)
    s = SK.daily_sketches(df, "ts", ["x", "y"]).cache()
    got = {r.feature: r.psi for r in SK.sketch_psi(s.where("day < '2024-01-15'"), s.where("day >= '2024-01-25'")).collect()}
    assert got["x"] > 0.5 and got["y"] < 0.1
    assert SK.merged(s.limit(0)).count() == 0


def orders(spark, seed=1):
    return spark.range(4000).select((F.col("id") * 7 % 50).alias("customer_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.rand(seed) * 120).cast("int"), F.col("id") % 24)).alias("order_date"),
                                    F.round(F.rand(seed + 1) * 100, 2).cast("decimal(18,2)").alias("order_amount"),
                                    F.element_at(F.array(*map(F.lit, METHODS + ["zz"])), (F.col("id") % 5 + 1).cast("int")).alias("payment_method"))


def rebuilt(rows, as_of):
    rows = rows.withColumn("m", F.when(F.col("payment_method").isin(METHODS), F.col("payment_method")).otherwise("other"))
    at = F.lit(as_of).cast("timestamp")
    inside = {n: (F.col("order_date") >= at - F.make_dt_interval(F.lit(n))) & (F.col("order_date") < at) for n in (7, 30, 90)}
    d = {n: F.count_distinct(F.when(inside[n], F.to_date("order_date"))) for n in (7, 90)}
    return rows.where(inside[90]).groupBy("customer_id").agg(
        *[x for n in (7, 30, 90) for x in (F.coalesce(F.sum(F.when(inside[n], F.col("order_amount"))), F.lit(0)).alias(f"v{n}"), F.count(F.when(inside[n], 1)).alias(f"c{n}"))],
        (7.0 / F.greatest(F.lit(1), d[7])).alias("f7"), (90.0 / (d[90] + 1)).alias("f90"), F.count_distinct("m").alias("m"))


def same(a, b):
    rows = [sorted(tuple(float(v) for v in r) for r in x.collect()) for x in (a, b)]
    return rows[0] == rows[1] and len(rows[0]) > 0


def test_state_equals_a_full_rebuild(spark, tmp_path):
    path, all_rows = str(tmp_path / "state"), orders(spark).cache()
    DY.store_days(DY.transaction_days(all_rows, METHODS), path)
    for as_of in ("2024-02-10", "2024-04-01"):
        assert same(DY.window_features(DY.read_days(spark, path, as_of, 90), as_of), rebuilt(all_rows, as_of))
    # A past day is corrected: only that day is written.
    day = "order_date >= '2024-03-20' and order_date < '2024-03-21'"
    right = all_rows.where(day).where("customer_id % 3 > 0").withColumn("order_amount", F.col("order_amount") + 1)
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    DY.store_days(DY.transaction_days(right, METHODS), path)
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    assert {d for d in before if before[d] != after[d]} == {"day=2024-03-20"}
    corrected = all_rows.where(f"not ({day})").unionByName(right)
    state = DY.read_days(spark, path, "2024-04-15", 90)
    assert same(DY.window_features(state, "2024-04-15"), rebuilt(corrected, "2024-04-15"))
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and plan.count("FileScan") == 1
    DY.drop_days(spark, path, ["2024-03-20"])
    assert DY.read_days(spark, path, "2024-04-15").where("day = '2024-03-20'").count() == 0


def test_sessions_merge_over_days(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 11).alias("customer_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id") % 20)).alias("event_timestamp"),
                                  (F.col("id") * 37 % 900 * 100).alias("session"))
    path = str(tmp_path / "sessions")
    DY.store_days(DY.session_days(df, "session"), path)
    got = {(r.customer_id, r.sessions) for r in DY.session_counts(DY.read_days(spark, path, "2024-03-01")).collect()}
    assert got == {(r.customer_id, r.n) for r in df.groupBy("customer_id").agg(F.count_distinct("session").alias("n")).collect()}


def test_nulls_have_no_state(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, None, None, None)], "customer_id bigint, order_date timestamp, order_amount decimal(18,2), payment_method string")
    assert DY.transaction_days(rows, METHODS).count() == 0
    one = spark.sql("select 1 customer_id, timestamp'2024-01-01 05:00:00' order_date, cast(null as decimal(18,2)) order_amount, cast(null as string) payment_method")
    r = DY.window_features(DY.transaction_days(one, METHODS), "2024-01-03").first()
    assert (r.order_count_7d, r.purchase_value_7d, r.payment_method_diversity) == (1, 0, 0)
