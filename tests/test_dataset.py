"""Splits, scaling, weights, cleaning."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from retainly.operators import clean as C
from retainly.operators import dataset as DS


def test_split_disjoint_and_complete(spark):
    df = spark.range(5000).withColumnRenamed("id", "customer_id").withColumn("y", (F.col("customer_id") % 7 == 0).cast("int"))
    s = DS.stratified_split(df, "customer_id", "y").toPandas()
    assert len(s) == 5000 and set(s.split) == {"train", "validation", "test"}
    share = s.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.70) < 0.03 and abs(share["test"] - 0.15) < 0.03
    again = DS.stratified_split(df, "customer_id", "y").toPandas()
    assert (again.sort_values("customer_id").split.values == s.sort_values("customer_id").split.values).all()


def test_standard_scaling_population_std(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"customer_id": range(100), **{f"f{i}": rng.normal(i, 3, 100) for i in range(5)},
                        "const": 1.0})
    cols = [f"f{i}" for i in range(5)] + ["const"]
    out = DS.standard_scale(spark.createDataFrame(pdf), cols).toPandas()
    for c in cols[:-1]:
        assert abs(out[c].mean()) < 1e-10 and abs(out[c].std(ddof=0) - 1) < 1e-10
    assert (out["const"] == 0).all()


def test_forward_fill_and_dedup(spark):
    rows = [(1, 1, 10.0), (1, 2, None), (1, 3, None), (1, 4, 7.0), (2, 1, None), (2, 2, 3.0)]
    df = spark.createDataFrame(rows, "k long, t long, x double")
    got = sorted(C.fill_forward(df, ["x"], "k", ["t"]).collect())
    assert [r["x"] for r in got] == [10.0, 10.0, 10.0, 7.0, None, 3.0]
    d = spark.createDataFrame([(1, 5, "b"), (1, 3, "z"), (2, 1, "a")], "k long, o long, s string")
    kept = sorted(C.drop_duplicates(d, ["k"], order=["o"]).collect())
    assert [(r["k"], r["o"]) for r in kept] == [(1, 3), (2, 1)]


def test_mode_and_median_fill(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "b", 3.0), (4, None, 10.0)],
                               "i long, c string, x double")
    m = {r["i"]: r for r in C.fill_median(C.fill_mode(df, ["c"]), ["x"]).collect()}
    assert m[4]["c"] == "b" and m[2]["x"] == 3.0


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 25 + [(0,)] * 75, "y int")
    w = {r["y"]: r for r in DS.class_weights(df, "y").collect()}
    assert w[1]["balanced_weight"] == 2.0 and abs(w[0]["balanced_weight"] - 0.666667) < 1e-9
    assert w[1]["scale_pos_weight"] == 3.0
