"""Empty, constant, all-NULL and NaN inputs; results that must not depend on files, tasks or defaults."""

import math

import pytest
from pyspark.sql import functions as F

from retainly.operators import account as A
from retainly.operators import clean as C
from retainly.operators import customer as CU
from retainly.operators import dataset as DS
from retainly.operators import drift as D
from retainly.operators import evaluate as E
from retainly.operators import monitor as M
from retainly.operators import quality as Q
from retainly.operators import score as SC
from retainly.operators import train as TR
from retainly.sources import io as IO
from retainly.streaming import jobs as J

NAN = float("nan")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_zscore_keeps_a_constant_column(spark):
    assert C.remove_outliers_zscore(frame(spark, [(5.0,), (5.0,), (None,), (NAN,)], "x double"), "x").count() == 2
    assert C.remove_outliers_zscore(frame(spark, [], "x double"), "x").count() == 0


def test_means_skip_nan(spark):
    df = frame(spark, [(1.0,), (3.0,), (NAN,), (None,)], "x double")
    assert sorted(r.x for r in C.fill_mean(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(r.x for r in C.fill_max(df, ["x"]).collect()) == [1.0, 3.0, 3.0, 3.0]
    stats = D.reference_statistics(df, ["x"]).first()
    assert (stats["mean"], stats["max"], stats["median"]) == (2.0, 3.0, 2.0)


def test_fill_constant(spark):
    assert sorted(r.x for r in C.fill_constant(frame(spark, [(1,), (None,)], "x int"), {"x": 7}).collect()) == [1, 7]


def test_gates_and_reports_on_empty_input(spark):
    empty = frame(spark, [], "x double, y int")
    gates = Q.quality_gates(empty, ["x", "y"]).collect()
    assert [(g.null_share, g.null_gate_failed, g.constant_gate_failed) for g in gates] == [(None, 0, 1)] * 2
    assert Q.integrity_report(empty).count() > 0
    assert [r.out_of_range for r in Q.range_assertions(empty, [("x", 0, 1)]).collect()] == [0]


def test_one_pass_means_one_scan(spark, tmp_path):
    frame(spark, [(float(i), float(i * i % 7), float(i % 3)) for i in range(50)], "a double, b double, c double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (Q.range_assertions(df, [("a", 0, 1), ("b", 0, 1), ("c", 0, 1)]), Q.quality_gates(df, ["a", "b", "c"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1
    both = D.correlation_drift(df, df, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert both.count("Relation [") == 2


def test_drift_without_values_on_a_side(spark):
    ref = frame(spark, [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], "x double, z double")
    none = frame(spark, [(None, 1.0), (None, 2.0)], "x double, z double")
    rows = {r.feature: r for r in D.ks_two_sample(ref, none, ["x", "z"], n_buckets=4).collect()}
    assert rows["x"].ks_statistic is None and rows["x"].is_drift == 0 and rows["z"].is_drift == 1
    shift = {r.feature: r for r in D.quantile_shift(ref, ref.withColumn("z", F.lit(1.0)), ["x", "z"]).collect()}
    assert shift["z"].quantile_psi is None and shift["x"].quantile_psi == 0


def test_response_table(spark):
    label, prediction = frame(spark, [(1,)], "significant_shift bigint"), frame(spark, [(0,)], "prediction_drift bigint")
    for n, want in ((0, [0, 0, 1, 0]), (1, [1, 0, 1, 0]), (3, [0, 1, 1, 0])):
        features = frame(spark, [(f"f{i}", int(i < n)) for i in range(4)], "feature string, is_drift bigint")
        assert [r.detected for r in D.drift_actions(features, label, prediction).collect()] == want


def test_split_shares_hold_in_each_class(spark):
    df = frame(spark, [(i, int(i % 9 == 0)) for i in range(900)], "k bigint, y int")
    got = {(r.y, r.split): r["count"] for r in DS.stratified_split(df, "k", "y").groupBy("y", "split").count().collect()}
    assert got == {(0, "train"): 560, (0, "validation"): 120, (0, "test"): 120, (1, "train"): 70, (1, "validation"): 15, (1, "test"): 15}


def test_weights_come_from_the_training_rows(spark):
    df = frame(spark, [(0, "train"), (0, "train"), (0, "train"), (1, "train"), (1, "test"), (1, "test")], "y int, split string")
    w = {r.y: r.weight for r in DS.with_weights(df, "y", fit=df.filter("split = 'train'")).collect()}
    assert w == {0: round(4 / 6, 6), 1: 2.0}


def test_retrain_rules(spark):
    schema = "days_since_update int, drift_detected int, degraded int, manual int"
    rows = [(None, 0, 0, 0), (3, 0, 0, 0), (30, 1, 1, 1)]
    got = [(r.should_retrain, r.triggers) for r in M.retrain_decision_variant(frame(spark, rows, schema)).collect()]
    assert got[0] == (1, "30-day scheduled retraining") and got[1] == (0, "No retraining needed")
    assert got[2][1].split("; ") == list(M.RETRAIN_REASONS)
    state = frame(spark, [(0.9, 0.9, 0, 1, 1_234_567)], "current_pr_auc double, baseline_pr_auc double, drift_detected int, days_since_update int, new_samples bigint")
    assert M.retrain_decision(state).first().reasons == "New samples: 1,234,567"


def test_engagement_defaults(spark):
    support = frame(spark, [(1, 2.0)], "customer_id bigint, resolution_hours double")
    reviews = frame(spark, [], "customer_id bigint, rating double, sentiment_score double")
    r = CU.engagement_features(support, reviews).first()
    assert (r.avg_support_sentiment, r.reviews_count, r.avg_review_rating, r.review_sentiment_score) == (0.5, 0, 3.0, 0.5)


def test_gaps_are_against_the_named_group(spark):
    rows = [(s, i % 2, (i % 2) * 0.6 + j * 0.01 * (s == "a")) for s in "ab" for i in range(10) for j in range(3)]
    got = {r.s: r for r in E.fairness_gaps(frame(spark, rows, "s string, y int, p double"), "y", "p", "s", "b").collect()}
    assert got["b"].auc_gap == 0 and got["b"].recall_gap == 0 and set(got) == {"a", "b"}
    assert {r.auc_gap for r in E.fairness_gaps(frame(spark, rows, "s string, y int, p double"), "y", "p", "s", "q").collect()} == {None}


def test_absent_features_are_zero(spark):
    df = frame(spark, [(1, {"a": 2.0}), (2, {}), (3, None)], "id int, f map<string,double>")
    assert [(r.a, r.b) for r in SC.features_from_map(df, "f", ["a", "b"]).orderBy("id").collect()] == [(2.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    got = SC.prepare_features(frame(spark, [(1, None)], "id int, a double"), ["b", "a"])
    assert got.columns == ["id", "b", "a"] and tuple(got.first()) == (1, 0.0, 0.0)


def labelled(spark, n=400):
    return spark.range(n).select("id", (F.rand(3) * 1.5 + F.col("id") % 2).alias("x"), F.rand(4).alias("z"), (F.col("id") % 2).cast("double").alias("label"),
                                 F.lit(1.0).alias("weight"))


def test_models_learn_a_signal_and_explain_it(spark):
    df = labelled(spark)
    model = TR.pipeline(["x", "z"], TR.estimators()["logistic_regression"]).fit(df)
    scored = SC.score(model, df, 0.35, "v", "2001-01-01 00:00:00")
    assert all(0 <= r.churn_probability <= 1 for r in scored.collect())
    assert TR.model_metrics(model, df, "label").first().roc_auc > 0.8
    lr = model.stages[-1]
    coefs = lr.coefficients.toArray().tolist()
    for r in SC.linear_explanation(scored, ["x", "z"], coefs, 2).limit(20).collect():
        total = lr.intercept + sum(e.contribution for e in r.explanation)
        assert 1 / (1 + math.exp(-total)) == pytest.approx(r.churn_probability, abs=1e-9)
    assert TR.feature_importance(model, ["x", "z"]).first().feature == "x"


def test_boosting_stops_on_validation_rows(spark):
    df = labelled(spark).withColumn("stop", F.col("id") % 5 == 0)
    est = TR.estimators(stop="stop")["gradient_boosting"]
    assert est.getMaxIter() == 100 and est.getMaxDepth() == 6
    assert TR.pipeline(["x", "z"], est).fit(df).stages[-1].getNumTrees < 100


def test_baseline_unless_the_boosted_model_is_better(spark):
    schema = "model string, split string, roc_auc double"
    for boosted, want in ((0.8, "logistic_regression"), (0.81, "gradient_boosting"), (0.7, "logistic_regression")):
        rows = [("logistic_regression", "validation", 0.8), ("gradient_boosting", "validation", boosted), ("gradient_boosting", "test", 0.99)]
        assert TR.baseline_or_boosted(frame(spark, rows, schema)).first().selected_model == want


def test_dedup_landing_is_independent_of_the_files(spark, tmp_path):
    events = spark.range(3000).select((F.col("id") % 300).alias("customer_id"),
                                      (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id") % 30, F.col("id") % 24)).alias("event_timestamp"))
    want = events.distinct().count()
    for files in (1, 12):
        src = str(tmp_path / f"src{files}")
        events.repartition(files).write.parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        out = str(tmp_path / f"out{files}")
        J.land_raw_events(J.dedup_events(stream, "1 day"), out, str(tmp_path / f"ckpt{files}")).awaitTermination()
        assert spark.read.parquet(out).count() == want


def test_stream_scores_every_event(spark, tmp_path):
    df = labelled(spark).withColumnRenamed("id", "customer_id")
    model = TR.pipeline(["x", "z"], TR.estimators()["logistic_regression"]).fit(df)
    events = frame(spark, [(1, "2024-01-01 00:00:00"), (10**6, "2024-01-01 01:00:00")], "customer_id bigint, event_timestamp string") \
        .withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    got = {r.customer_id: r.churn_probability for r in J.score_stream(events, df.select("customer_id", "x", "z"), model).collect()}
    assert set(got) == {1, 10**6} and all(0 <= p <= 1 for p in got.values())


def test_writes_leave_the_session_and_other_days_alone(spark, tmp_path):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    rows = frame(spark, [(1, "2024-01-01"), (2, "2024-01-02")], "id int, d string").withColumn("d", F.col("d").cast("date"))
    IO.save_to_datalake(rows, str(tmp_path), "t", "d")
    IO.save_to_datalake(rows.filter("id = 2"), str(tmp_path), "t", "d")
    assert sorted(r.id for r in IO.read_datalake(spark, str(tmp_path), "t").collect()) == [1, 2]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_batch_reads_start_at_the_earliest_offset(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(IO, "kafka_options", lambda **kw: seen.update(kw) or {"path": "/nowhere"})
    with pytest.raises(Exception):
        IO.read_kafka_batch(spark, bootstrap="h:1", topics="t")
    assert seen["starting"] == "earliest"


def test_account_extras_without_sources(spark):
    accounts = frame(spark, [(1, None, None, None, True, None)], "customer_id bigint, email_verified_at timestamp, phone_verified_at timestamp, "
                     "email_marketing_opt_in boolean, sms_marketing_opt_in boolean, push_notification_opt_in boolean")
    none = lambda s: frame(spark, [], "customer_id bigint, " + s)
    r = A.account_extras(accounts, none("method string"), none("address_type string"), none("subscription_end_date timestamp_ntz"),
                         none("deleted_at timestamp_ntz"), none("spend double"), none("order_amount double, order_date timestamp_ntz"), "2001-08-02 00:00:00").first()
    assert r.sms_marketing_opt_in == 1 and r.email_marketing_opt_in == 0 and r.acquisition_efficiency is None and r.subscription_x_frequency30 == 0
