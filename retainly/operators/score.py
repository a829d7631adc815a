"""Table scoring (P1-P10): a request server re-aimed as a batch job.

Scores are appended to a customer table by `PipelineModel.transform`;
every response field is a column expression; the risk percentile is the
distributed percent rank (no global single-task sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from .dataset import standard_scale
from .ordered import join_by_value, value_ranks

DEFAULT_THRESHOLD = 0.35
# Risk bands of the scoring contract.
LOW_RISK, HIGH_RISK = 0.30, 0.70
RECOMMENDATIONS = {"high": "Enroll in retention campaign", "medium": "Send engagement offer",
                   "low": "No action"}


def prepare_features(df: DataFrame, features, params: DataFrame | None = None) -> DataFrame:
    """Model-ordered feature columns, absent -> 0 (NULL, or no such
    column), scaled with the training parameters (T3)."""
    keep = [F.col(c) for c in df.columns if c not in features]
    filled = df.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in df.columns
                                else F.lit(0.0).alias(f) for f in features])
    return standard_scale(filled, list(features), params) if params is not None else filled


def features_from_map(df: DataFrame, column: str, features) -> DataFrame:
    """P1 for requests: a map<string, number> column as feature columns, absent -> 0."""
    return df.select(*[c for c in df.columns if c != column],
                     *[F.coalesce(F.try_element_at(column, F.lit(f)).cast("double"), F.lit(0.0)).alias(f) for f in features])


def score(model, df: DataFrame, threshold: float = DEFAULT_THRESHOLD, version: str = "v1",
          scored_at: str | None = None) -> DataFrame:
    """Probability, class at `threshold`, model version and timestamp."""
    from pyspark.ml.functions import vector_to_array
    p = model.transform(df).withColumn("churn_probability", vector_to_array("probability")[1])
    ts = F.lit(scored_at).cast("timestamp_ntz") if scored_at else F.current_timestamp()
    return p.withColumn("model_version", F.lit(version)).withColumn("scored_at", ts) \
        .drop("features", "rawPrediction", "probability", "prediction")


def risk_fields(df: DataFrame, prob: str = "churn_probability", threshold: float = DEFAULT_THRESHOLD,
                key: str = "customer_id") -> DataFrame:
    """Confidence (2|p - 0.5|, and max(p, 1 - p)), class at threshold,
    risk band, percentile among all rows (percent rank x 100), recommendation."""
    p = F.col(prob)
    band = F.when(p < LOW_RISK, "low").when(p <= HIGH_RISK, "medium").otherwise("high")
    r = value_ranks(df.select(prob), prob)
    pct = F.when(F.col("_n") > 1, F.col("_below") / (F.col("_n") - 1) * 100).otherwise(F.lit(0.0))
    j = join_by_value(df, r.select(prob, "_cnt", "_n", pct.alias("risk_percentile")), [prob])
    rec = F.coalesce(*[F.when(F.col("risk_band") == k, F.lit(v)) for k, v in RECOMMENDATIONS.items()])
    return j.select(*df.columns,
                    as_double(2 * F.abs(p - 0.5)).alias("confidence"),
                    as_double(F.greatest(p, 1 - p)).alias("confidence_max"),
                    as_long(p > threshold).alias("predicted_churn"),
                    band.alias("risk_band"), as_double("risk_percentile").alias("risk_percentile")) \
        .withColumn("recommendation", rec)


def risk_counters(df: DataFrame) -> DataFrame:
    """P10: customers per risk band and their average confidence."""
    return df.groupBy("risk_band").agg(as_long(F.count(F.lit(1))).alias("customers"),
                                       as_double(F.avg("confidence")).alias("avg_confidence"))


def linear_explanation(df: DataFrame, features, coefficients, top: int = 5) -> DataFrame:
    """Top contributing features of a linear model on standardized inputs:
    contribution = coefficient x scaled value, sorted by |contribution|."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(float(c)) * F.col(f)).alias("contribution"),
                               F.col(f).cast("double").alias("value"))
                      for f, c in zip(features, coefficients)])
    ordered = F.array_sort(items, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1)
                           .when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
                           .otherwise(F.when(a["feature"] < b["feature"], -1).otherwise(1)))
    return df.withColumn("explanation", F.slice(ordered, 1, top))
