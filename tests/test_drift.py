"""Drift operators: seeded shifts (as in the reference tests) and properties."""

import numpy as np
import pandas as pd
import pytest

from retainly.operators.drift import hellinger, ks_two_sample, label_shift, psi


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(42)
    ref = pd.DataFrame({"feature_1": rng.normal(0, 1, 1000), "feature_2": rng.normal(5, 2, 1000),
                        "feature_3": rng.exponential(2, 1000)})
    cur = pd.DataFrame({"feature_1": rng.normal(2, 1, 1000), "feature_2": rng.normal(5, 2, 1000),
                        "feature_3": rng.exponential(2, 1000)})
    return spark.createDataFrame(ref), spark.createDataFrame(cur), ref, cur


COLS = ["feature_1", "feature_2", "feature_3"]


def test_ks_detects_shift_only(frames):
    ref, cur, pref, pcur = frames
    r = {x["feature"]: x for x in ks_two_sample(ref, cur, COLS, 0.1).collect()}
    assert r["feature_1"]["is_drift"] == 1
    assert r["feature_2"]["is_drift"] == 0 and r["feature_3"]["is_drift"] == 0
    # exact D against a direct ECDF computation
    for c in COLS:
        v = np.sort(np.concatenate([pref[c], pcur[c]]))
        d = np.max(np.abs(np.searchsorted(np.sort(pref[c]), v, "right") / 1000
                          - np.searchsorted(np.sort(pcur[c]), v, "right") / 1000))
        assert abs(r[c]["ks_statistic"] - round(d, 6)) < 1e-9


def test_ks_and_psi_of_identical_samples_are_zero(frames):
    ref, _, _, _ = frames
    assert all(x["ks_statistic"] == 0 for x in ks_two_sample(ref, ref, COLS).collect())
    assert all(abs(x["psi"]) < 1e-12 for x in psi(ref, ref, COLS).collect())


def test_psi_shifted_greater_than_unshifted(frames):
    ref, cur, _, _ = frames
    r = {x["feature"]: x["psi"] for x in psi(ref, cur, COLS).collect()}
    assert r["feature_1"] > r["feature_2"] and r["feature_1"] > 0.2


def test_label_shift_and_hellinger(spark):
    a = spark.createDataFrame([(1,)] * 15 + [(0,)] * 85, "y int")
    b = spark.createDataFrame([(1,)] * 40 + [(0,)] * 60, "y int")
    r = label_shift(a, b, "y").first()
    exp = 0.4 * np.log(0.4 / 0.15) + 0.6 * np.log(0.6 / 0.85)
    assert abs(r["kl_divergence"] - round(exp, 6)) < 1e-9 and r["significant_shift"] == 1
    s = spark.createDataFrame([(x / 10,) for x in range(10)], "p double")
    assert hellinger(s, s, "p").first()["hellinger"] == 0.0
