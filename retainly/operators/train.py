"""Model training and selection on `pyspark.ml`.

Estimators are Spark's distributed learners; the reference's settings are
kept where Spark has the same knob (depth, learning rate, rounds, subsample,
trees, minimum leaf size, class weights through `weightCol`). Metrics use
our exact ROC / PR operators over the predicted probability column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_double, as_long
from ..session import materialize
from . import boosting
from .evaluate import confusion_metrics, curve_metrics

# Model settings of the reference configuration.
LR_MAX_ITER = 1000
GBT_DEPTH, GBT_STEP, GBT_ROUNDS, GBT_SUBSAMPLE = 6, 0.1, 100, 0.8
GBT2_ROUNDS = 200
RF_TREES, RF_DEPTH, RF_MIN_LEAF = 100, 10, 5
LEAFWISE = boosting.Settings(rounds=200, leaves=31, rate=0.1, rows=0.8, columns=0.8, patience=50)

def estimators(label: str = "label", weight: str | None = "weight", seed: int = 42, stop: str | None = None) -> dict:
    """Logistic baseline, two boosted-tree settings, random forest.

    `stop` names a boolean column of validation rows: boosting ends when the
    loss on them no longer falls (`validationIndicatorCol`); its rows don't
    train. Without it all rounds are run."""
    w = {"weightCol": weight} if weight else {}
    early = {"validationIndicatorCol": stop} if stop else {}
    boosted = dict(labelCol=label, featuresCol="features", maxDepth=GBT_DEPTH, stepSize=GBT_STEP,
                   subsamplingRate=GBT_SUBSAMPLE, seed=seed, **w, **early)
    return {
        "logistic_regression": LogisticRegression(labelCol=label, featuresCol="features", maxIter=LR_MAX_ITER, **w),
        "gradient_boosting": GBTClassifier(maxIter=GBT_ROUNDS, **boosted),
        "gradient_boosting_long": GBTClassifier(maxIter=GBT2_ROUNDS, **boosted),
        "random_forest": RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=RF_TREES,
                                                maxDepth=RF_DEPTH, minInstancesPerNode=RF_MIN_LEAF, seed=seed, **w),
    }


def pipeline(features, estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features",
                                            handleInvalid="keep"), estimator])


def probability(pred: DataFrame, out: str = "p") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


def model_metrics(model, df: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """E1-E5 of a fitted model on df (1 row). Scores are saved, as several passes read them."""
    p = materialize((model.score(df) if isinstance(model, boosting.Model) else probability(model.transform(df))).select(label, "p"))
    return confusion_metrics(p, label, "p", threshold).crossJoin(curve_metrics(p, label, "p"))


def train_and_compare(train: DataFrame, val: DataFrame, test: DataFrame, features, label: str,
                      weight: str | None = "weight", only=None):
    """Fit every estimator and the leaf-wise trees (T8), or those named in
    `only` (boosted trees stop early on the validation rows), report validation
    and test metrics, choose the best by validation PR-AUC (never by test).
    Returns (metrics DataFrame, {name: fitted model})."""
    models, rows = {}, []
    both = train.withColumn("_stop", F.lit(False)).unionByName(val.withColumn("_stop", F.lit(True)))
    fits = {name: lambda est=est: pipeline(features, est).fit(both if est.hasParam("validationIndicatorCol") else train)
            for name, est in estimators(label, weight, stop="_stop").items()}
    fits["leafwise_boosting"] = lambda: boosting.fit(both, features, label, weight, "_stop", LEAFWISE)
    for name, fit in fits.items():
        if only is not None and name not in only:
            continue
        models[name] = m = fit()
        for split, d in (("validation", val), ("test", test)):
            rows.append(model_metrics(m, d, label).select(F.lit(name).alias("model"), F.lit(split).alias("split"),
                                                          "precision", "recall", "f1_score", "roc_auc", "pr_auc"))
    met = materialize(reduce(DataFrame.unionByName, rows))  # a row a model and split
    best = met.filter(F.col("split") == "validation").agg(F.max_by("model", F.struct("pr_auc", "roc_auc"))
                                                          .alias("best_model"))
    return met.crossJoin(best).withColumn("selected", (F.col("model") == F.col("best_model")).cast("bigint")) \
        .drop("best_model"), models


def baseline_or_boosted(metrics: DataFrame, split: str = "validation", baseline: str = "logistic_regression",
                        boosted: str = "gradient_boosting") -> DataFrame:
    """The boosted model if its ROC-AUC is strictly higher, else (ties
    included) the baseline. metrics: rows of `train_and_compare`."""
    m = metrics.filter(F.col("split") == split)
    row = m.agg(F.max(F.when(F.col("model") == baseline, F.col("roc_auc"))).alias("baseline_roc_auc"),
                F.max(F.when(F.col("model") == boosted, F.col("roc_auc"))).alias("boosted_roc_auc"))
    better = F.coalesce(F.col("boosted_roc_auc") > F.col("baseline_roc_auc"), F.lit(False))
    return row.select("*", F.when(better, boosted).otherwise(baseline).alias("selected_model"))


def feature_importance(model, features) -> DataFrame:
    """Tree importances (or |coefficients| for the linear model) with the
    assembler's feature names, sorted descending."""
    est = model.stages[-1]
    vals = est.featureImportances.toArray() if hasattr(est, "featureImportances") else \
        [abs(x) for x in est.coefficients.toArray()]
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def cross_validate(train: DataFrame, features, label: str, weight: str | None = "weight", folds: int = 5, seed: int = 42):
    """K-fold cross-validated logistic regression with class weights (ROC-AUC)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    est = estimators(label, weight, seed)["logistic_regression"]
    grid = ParamGridBuilder().addGrid(est.regParam, [0.0, 0.1]).build()
    cv = CrossValidator(estimator=pipeline(features, est), estimatorParamMaps=grid,
                        evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=seed, parallelism=len(grid))
    return cv.fit(train)


def correlation_selection(df: DataFrame, features, label: str) -> DataFrame:
    """All features with their rank by |Pearson correlation| with the
    label, ties by name (all correlations in one aggregate; a caller selects
    by rank)."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features])
    long = row.unpivot([], list(features), "feature", "corr")
    ranked = long.select("feature", as_double("corr").alias("corr"), as_double(F.abs("corr")).alias("abs_corr"))
    return ranked.withColumn("rank", as_long(F.row_number().over(  # one row per feature
        Window.orderBy(F.desc_nulls_last("abs_corr"), "feature"))))
