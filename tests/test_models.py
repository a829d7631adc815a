"""Approximate fences, cross-validation, model comparison and the fills and defaults of single columns."""

import pytest
from pyspark.sql import functions as F

from retainly.operators import boosting as B
from retainly.operators import clean as C
from retainly.operators import customer as CU
from retainly.operators import quality as Q
from retainly.operators import train as TR
from retainly.plans import modeling as M


def test_approximate_quartiles_are_within_the_rank_error(spark):
    df = spark.range(5000).select((F.exp(F.randn(5)) * 100).alias("x")).cache()
    v = sorted(r.x for r in df.collect())
    kept = sorted(r.x for r in C.remove_outliers_iqr(df, "x", 0.05).collect())
    at = lambda p: v[min(len(v) - 1, max(0, int(p * len(v))))]
    fence = lambda a, b: (a - 1.5 * (b - a), b + 1.5 * (b - a))
    low, high = fence(at(0.20), at(0.80)), fence(at(0.30), at(0.70))  # quartiles off by 0.05 either way
    assert kept == [x for x in v if kept[0] <= x <= kept[-1]]
    assert max(x for x in v if x <= high[1]) <= kept[-1] <= low[1] and len(kept) < len(v)


def rows(spark, n=600):
    df = spark.range(n).select("id", F.randn(1).alias("x"), F.randn(2).alias("z"), F.rand(3).alias("u"), F.lit(1.0).alias("weight"))
    return df.withColumn("label", (F.col("u") < 1 / (1 + F.exp(-2 * F.col("x")))).cast("double")).cache()


def test_cross_validation_finds_the_signal(spark):
    model = TR.cross_validate(rows(spark), ["x", "z"], "label", folds=3)
    assert len(model.avgMetrics) == 2 and max(model.avgMetrics) > 0.75
    noise = TR.cross_validate(rows(spark).withColumn("x", F.randn(9)), ["x", "z"], "label", folds=3)
    assert max(noise.avgMetrics) < 0.65


def test_comparison_selects_by_validation(spark, monkeypatch):
    monkeypatch.setattr(TR, "LEAFWISE", B.Settings(rounds=4, patience=4))
    df = rows(spark)
    # On the test rows labels are turned round: a choice by test would be another.
    tr, va, te = df.where("id % 4 < 2"), df.where("id % 4 = 2"), df.where("id % 4 = 3").withColumn("label", 1 - F.col("label"))
    met, models = TR.train_and_compare(tr, va, te, ["x", "z"], "label", only=("logistic_regression", "leafwise_boosting"))
    got = {(r.model, r.split): r for r in met.collect()}
    assert set(got) == {(m, s) for m in models for s in ("validation", "test")} and set(models) == {"logistic_regression", "leafwise_boosting"}
    best = max(models, key=lambda m: got[m, "validation"].pr_auc)
    assert {m for (m, _), r in got.items() if r.selected} == {best}
    assert all(got[m, "validation"].roc_auc > 0.7 > 0.5 > got[m, "test"].roc_auc for m in models)


def test_metrics_read_saved_scores(spark, monkeypatch):
    df = rows(spark)
    model = B.fit(df, ["x", "z"], "label", settings=B.Settings(rounds=2))
    plan = TR.model_metrics(model, df, "label")._jdf.queryExecution().optimizedPlan().toString()
    assert "margin" not in plan and "LogicalRDD" in plan


def test_labels_are_made_once_for_a_split(spark, monkeypatch):
    monkeypatch.setattr(M, "_labels", lambda t: spark.range(200).select(F.col("id").alias("customer_id"), (F.col("id") % 3 == 0).cast("bigint").alias("churn")))
    found = M._split(None)
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.split: r["count"] for r in found.groupBy("split").count().collect()}.keys() == {"train", "validation", "test"} and found.count() == 200


def test_fill_by_family(spark):
    df = spark.createDataFrame([(1.0, "a", None, None), (2.0, "b", 4, None), (9.0, "b", 8, 1), (None, None, None, None)], "x double, c string, m int, k int")
    got = C.fill_by_family(df, {"x": 50, "c": "mode", "m": "max", "k": ("constant", 7)}).collect()
    assert sorted(tuple(r) for r in got) == [(1.0, "a", 8, 7), (2.0, "b", 4, 7), (2.0, "b", 8, 7), (9.0, "b", 8, 1)]


def test_all_caps_apply(spark):
    df = spark.createDataFrame([(20_000, 2e5, 1500), (1, 1.0, None)], "days_since_last_purchase int, total_spend double, support_tickets bigint")
    assert [tuple(r) for r in Q.apply_caps(df, Q.FEATURE_CAPS).collect()] == [(15000, 100000.0, 1000), (1, 1.0, None)]


def test_temporal_features_without_a_date(spark):
    r = CU.temporal_features(spark.range(2), "order_date", "id", "2024-03-09").first()
    assert (r.day_of_week, r.month, r.quarter, r.is_weekend) == (5, 3, 1, 1)
    with pytest.raises(ValueError):
        CU.temporal_features(spark.range(2), "order_date", "id")
