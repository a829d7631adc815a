"""Performance monitoring, reports and retraining decisions.

Metric tables are long: (model_version, ts, metric, value). Comparisons are
equi-joins on the metric name; decisions are row-wise expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from .evaluate import confusion_metrics, curve_metrics
from .ordered import exact_quantiles

TRACKED = ("precision", "recall", "f1_score", "roc_auc", "pr_auc")


def metrics_long(df: DataFrame, label: str, score: str, threshold: float = 0.5, keys=()) -> DataFrame:
    """E1-E5 as a long table (keys..., metric, value)."""
    keys = list(keys)
    c = confusion_metrics(df, label, score, threshold, keys)
    a = curve_metrics(df, label, score, keys)
    w = c.join(a, keys) if keys else c.crossJoin(a)
    return w.select(*keys, F.explode(F.create_map(*[x for m in TRACKED for x in (F.lit(m), F.col(m))]))
                    .alias("metric", "value"))


def performance_degradation(current: DataFrame, baseline: DataFrame, threshold: float = 0.05) -> DataFrame:
    """M15-M16 on long tables (metric, value): relative change
    (cur - base) / base (NULL when base = 0) degraded when < -t; variant
    (base - cur) / base with base 0 -> 0, degraded when > t."""
    j = current.select("metric", F.col("value").alias("cur")).join(
        baseline.select("metric", F.col("value").alias("base")), "metric")
    ch = F.when(F.col("base") != 0, (F.col("cur") - F.col("base")) / F.col("base"))
    ch2 = F.when(F.col("base") != 0, (F.col("base") - F.col("cur")) / F.col("base")).otherwise(F.lit(0.0))
    return j.select("metric", as_double("cur").alias("current"), as_double("base").alias("baseline"),
                    as_double(ch).alias("change"), F.coalesce((ch < -threshold).cast("bigint"), F.lit(0)).alias("degraded"),
                    as_double(ch2).alias("drop"), (ch2 > threshold).cast("bigint").alias("degraded_variant"))


def latency_percentiles(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Min, max, mean and exact p50 / p95 / p99 per key."""
    keys = list(keys)
    basic = df.groupBy(*keys).agg(F.min(value).alias("mn"), F.max(value).alias("mx"), F.avg(value).alias("mean"),
                                  F.count(value).alias("n"))
    q = exact_quantiles(df, value, [0.5, 0.95, 0.99], keys)
    j = basic.join(q, keys) if keys else basic.crossJoin(q)
    return j.select(*keys, as_long("n").alias("n"), as_double("mn").alias("min"), as_double("mx").alias("max"),
                    as_double("mean").alias("mean"), as_double("q_0").alias("p50"), as_double("q_1").alias("p95"),
                    as_double("q_2").alias("p99"))


def monitoring_summary(ks: DataFrame, psi: DataFrame, label: DataFrame) -> DataFrame:
    """Drifted features, high-PSI features and the label-shift flag."""
    a = ks.agg(F.count_if(F.col("is_drift") == 1).alias("features_with_drift"))
    b = psi.agg(F.count_if(F.col("high_psi") == 1).alias("high_psi_features"))
    c = label.select(F.col("significant_shift").alias("significant_label_shift"))
    return a.crossJoin(b).crossJoin(c).select(*[as_long(x).alias(x) for x in (
        "features_with_drift", "high_psi_features", "significant_label_shift")])


def retrain_decision(state: DataFrame, drop_threshold: float = 0.05, max_age_days: int = 30,
                     new_samples_threshold: int = 1_000_000) -> DataFrame:
    """Per model row (current_pr_auc, baseline_pr_auc, drift_detected,
    days_since_update, new_samples): reasons joined by '; '."""
    reasons = F.array(
        F.when(F.col("current_pr_auc") < F.col("baseline_pr_auc") * (1 - drop_threshold),
               F.concat(F.lit("Performance degradation (PR-AUC: "),
                        F.format_number(F.col("current_pr_auc"), 4), F.lit(")"))),
        F.when(F.col("drift_detected") == 1, F.lit("Data drift detected")),
        F.when(F.col("days_since_update") >= max_age_days,
               F.concat(F.lit("Model age: "), F.col("days_since_update").cast("string"), F.lit(" days"))),
        F.when(F.col("new_samples") >= new_samples_threshold,
               F.concat(F.lit("New samples: "), F.format_number(F.col("new_samples"), 0))))
    kept = F.filter(reasons, lambda x: x.isNotNull())
    return state.select("*", (F.size(kept) > 0).cast("bigint").alias("should_retrain"),
                        F.when(F.size(kept) > 0, F.array_join(kept, "; "))
                        .otherwise(F.lit("No trigger conditions met")).alias("reasons"))


# Reasons of the second retraining rule, in order, and the text without any.
RETRAIN_REASONS = ("30-day scheduled retraining", "Data drift detected", "Performance degradation detected",
                   "Manual retraining request")
NO_RETRAIN = "No retraining needed"


def retrain_decision_variant(state: DataFrame, min_age_days: int = 30) -> DataFrame:
    """Retrain when age >= 30 days, drift, degradation or a manual flag. A
    model that was never retrained (NULL age) is infinitely old."""
    days = F.col("days_since_update")
    due = [days.isNull() | (days >= min_age_days), F.col("drift_detected") == 1, F.col("degraded") == 1, F.col("manual") == 1]
    kept = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in zip(due, RETRAIN_REASONS)]), lambda x: x.isNotNull())
    return state.select("*", (F.size(kept) > 0).cast("bigint").alias("should_retrain"),
                        F.when(F.size(kept) > 0, F.array_join(kept, "; ")).otherwise(F.lit(NO_RETRAIN)).alias("triggers"))


def metric_history(tagged: DataFrame, label: str, score: str, threshold: float = 0.5, version: str = "v1",
                   ts: str = "ts") -> DataFrame:
    """History table (model_version, ts, metric, value) from scored rows
    tagged with their evaluation time: metrics keyed by ts in one pass."""
    m = metrics_long(tagged.select(ts, label, score), label, score, threshold, [ts])
    return m.select(F.lit(version).alias("model_version"), F.col(ts).alias("ts"), "metric",
                    as_double("value").alias("value"))


def performance_trend(history: DataFrame, version: str, as_of: str, days: int) -> DataFrame:
    """One model's metrics in the last `days` days before as_of, by time."""
    lo = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return history.filter((F.col("model_version") == version)
                          & (F.col("ts").cast("timestamp_ntz") >= lo)).orderBy("ts", "metric")


def alerts(history: DataFrame, as_of: str, hours: int, severity: str | None = None,
           warn: float = 0.05, crit: float = 0.10) -> DataFrame:
    """Metric drops against the model's first history point, graded
    warning (> 5 %) / critical (> 10 %), restricted to the last `hours` hours
    and optionally to one severity."""
    first = history.groupBy("model_version", "metric").agg(F.min_by("value", "ts").alias("base"))
    j = history.join(first, ["model_version", "metric"])
    drop = F.when(F.col("base") != 0, (F.col("base") - F.col("value")) / F.col("base"))
    sev = F.when(drop > crit, "critical").when(drop > warn, "warning")
    lo = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    out = j.select("model_version", "ts", F.lit("performance").alias("source"), "metric", "value",
                   as_double(drop).alias("drop"), sev.alias("severity")) \
        .filter(F.col("severity").isNotNull() & (F.col("ts").cast("timestamp_ntz") >= lo))
    return out.filter(F.col("severity") == severity) if severity else out


def drift_alerts(ks: DataFrame, psi_table: DataFrame, version: str, ts: str) -> DataFrame:
    """Alert rows of one monitoring run: KS drift -> warning, PSI above its
    threshold -> critical (same columns as `alerts`)."""
    k = ks.filter(F.col("is_drift") == 1).select(
        F.lit(version).alias("model_version"), F.lit(ts).alias("ts"), F.lit("ks_drift").alias("source"),
        F.col("feature").alias("metric"), F.col("ks_statistic").alias("value"),
        F.lit(None).cast("double").alias("drop"), F.lit("warning").alias("severity"))
    p = psi_table.filter(F.col("high_psi") == 1).select(
        F.lit(version).alias("model_version"), F.lit(ts).alias("ts"), F.lit("psi").alias("source"),
        F.col("feature").alias("metric"), F.col("psi").alias("value"),
        F.lit(None).cast("double").alias("drop"), F.lit("critical").alias("severity"))
    return k.unionByName(p)
