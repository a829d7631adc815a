"""Classifier evaluation as aggregations.

Confusion counts are conditional aggregates (one pass, any number of
thresholds). ROC-AUC and PR-AUC are exact: scores are collapsed to distinct
values, cumulative positive / negative counts come from `ordered_prefix`
(no single-task global sort), and both areas are sums over distinct scores:

* ROC-AUC = sum pos(s) * (neg_below(s) + neg(s) / 2) / (P N)  (ties count 1/2);
* PR-AUC  = trapezoids between consecutive thresholds in descending order,
  anchored at (recall 0, precision 1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from .ordered import ordered_prefix


def _ratio(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, keys=()) -> DataFrame:
    """E1-E3 (+E8 at a chosen threshold): tn, fp, fn, tp, precision, recall,
    f1, accuracy, specificity; zero division -> 0. Predicted class: score > t."""
    keys = list(keys)
    pred = F.col(score) > threshold
    pos = F.col(label) == 1
    aggs = [F.count_if(~pred & ~pos).alias("tn"), F.count_if(pred & ~pos).alias("fp"),
            F.count_if(~pred & pos).alias("fn"), F.count_if(pred & pos).alias("tp")]
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return _confusion_ratios(g, keys)


def _confusion_ratios(g: DataFrame, keys, extra=()) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return g.select(*keys, *extra, as_long(tn).alias("tn"), as_long(fp).alias("fp"), as_long(fn).alias("fn"),
                    as_long(tp).alias("tp"), as_double(prec).alias("precision"), as_double(rec).alias("recall"),
                    as_double(_ratio(2 * prec * rec, prec + rec)).alias("f1_score"),
                    as_double(_ratio(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
                    as_double(_ratio(tn, tn + fp)).alias("specificity"))


def threshold_metrics(df: DataFrame, label: str, score: str, thresholds) -> DataFrame:
    """Confusion metrics at several thresholds from ONE aggregate pass."""
    pos = F.col(label) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        pred = F.col(score) > t
        aggs += [F.count_if(~pred & ~pos).alias(f"tn{i}"), F.count_if(pred & ~pos).alias(f"fp{i}"),
                 F.count_if(~pred & pos).alias(f"fn{i}"), F.count_if(pred & pos).alias(f"tp{i}")]
    row = df.agg(*aggs)
    parts = [_confusion_ratios(row.select(F.lit(float(t)).alias("threshold"),
                                          *[F.col(f"{c}{i}").alias(c) for c in ("tn", "fp", "fn", "tp")]),
                               [], [F.col("threshold")])
             for i, t in enumerate(thresholds)]
    return reduce(DataFrame.unionByName, parts)


def curve_metrics(df: DataFrame, label: str, score: str, keys=(), n_buckets: int | None = None) -> DataFrame:
    """Positives, negatives, roc_auc, pr_auc, gini per key (0 when a
    class is absent)."""
    keys = list(keys)
    base = df.select(*keys, F.col(score).cast("double").alias("_s"),
                     (F.col(label) == 1).cast("bigint").alias("pos"),
                     (F.col(label) != 1).cast("bigint").alias("neg")).filter(F.col("_s").isNotNull())
    op = ordered_prefix(base, "_s", ["pos", "neg"], keys, n_buckets=n_buckets)
    P, N = F.col("pos_total"), F.col("neg_total")
    tp = P - F.col("pos_below")
    fp = N - F.col("neg_below")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    prec = tp / (tp + fp)
    prec0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    pr_term = F.when(P > 0, ((tp - tp0) / P) * (prec + prec0) / 2)
    auc_term = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    g = op.groupBy(*keys, "pos_total", "neg_total").agg(F.sum(auc_term).alias("_auc"),
                                                        F.sum(pr_term).alias("_pr"))
    auc = F.when((P > 0) & (N > 0), F.col("_auc") / (P * N)).otherwise(F.lit(0.0))
    return g.select(*keys, as_long(P).alias("positives"), as_long(N).alias("negatives"),
                    as_double(auc).alias("roc_auc"),
                    as_double(F.when(P > 0, F.col("_pr")).otherwise(F.lit(0.0))).alias("pr_auc"),
                    as_double(2 * auc - 1).alias("gini"))


def calibration_table(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Equal-width probability bins: size, mean score, actual rate, abs
    error, and the maximum bin error (window over at most `bins` rows)."""
    from pyspark.sql import Window
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
                                       F.avg(F.col(label).cast("double")).alias("actual_rate"))
    err = F.abs(F.col("mean_score") - F.col("actual_rate"))
    return g.select(as_long("bin").alias("bin"), as_long("n").alias("size"),
                    as_double("mean_score").alias("mean_score"), as_double("actual_rate").alias("actual_rate"),
                    as_double(err).alias("abs_error"),
                    as_double(F.max(err).over(Window.partitionBy())).alias("max_calibration_error"))


def segment_metrics(df: DataFrame, label: str, score: str, segment: str, threshold: float = 0.35) -> DataFrame:
    """Confusion metrics and AUCs per segment."""
    c = confusion_metrics(df, label, score, threshold, [segment])
    a = curve_metrics(df, label, score, [segment])
    return c.join(a, segment)


def fairness_gaps(df: DataFrame, label: str, score: str, segment: str, baseline: str,
                  threshold: float = 0.35) -> DataFrame:
    """Per group gaps in roc_auc, precision and recall against the group
    `baseline` (its own gaps are 0); without that group the gaps are NULL."""
    seg = segment_metrics(df, label, score, segment, threshold)
    base = seg.filter(F.col(segment) == baseline).select(
        F.col("precision").alias("_bp"), F.col("recall").alias("_br"), F.col("roc_auc").alias("_ba"))
    j = seg.join(F.broadcast(base), F.lit(True), "left")  # one row
    return j.select(segment, "roc_auc", "precision", "recall",
                    as_double(F.col("roc_auc") - F.col("_ba")).alias("auc_gap"),
                    as_double(F.col("precision") - F.col("_bp")).alias("precision_gap"),
                    as_double(F.col("recall") - F.col("_br")).alias("recall_gap"))


# Minimum-metric gate of the settings.
METRIC_FLOORS = {"roc_auc": 0.85, "precision": 0.78, "recall": 0.72}


def metric_gate(metrics: DataFrame, floors=METRIC_FLOORS) -> DataFrame:
    """One row per gated metric: value, floor, passed (value >= floor)."""
    parts = [metrics.select(F.lit(m).alias("metric"), as_double(m).alias("value"),
                            F.lit(float(v)).alias("floor"), (F.col(m) >= v).cast("bigint").alias("passed"))
             for m, v in floors.items()]
    return reduce(DataFrame.unionByName, parts)
