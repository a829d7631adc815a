import zlib

import numpy as np

from retainly.llm import ranking

from .helpers import awkward, frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = ranking.classify(docs, ranking.fit(docs, labels))
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.95
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.98


def test_weights_follow_the_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (200, 3)), rng.normal(0, 1, (60, 3))
    good[:, 2] = bad[:1, 2]
    model = ranking.fit_pairs(good, bad)
    assert model.weights[0] > 0 and model.weights[1] > 0
    below = (model.scores(np.vstack([good, bad])) < ranking.THRESHOLD).mean()
    assert abs(below - 60 / 260) < 0.02  # the quantile is the share of label 0
    assert model.scores(good).mean() > model.scores(bad).mean()


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = ranking.fit(docs, labels), ranking.fit(docs, flipped)
    assert np.allclose(a.weights, b.weights) and a.cutoff == b.cutoff


def test_awkward_rows(spark):
    docs = awkward(spark)
    some = [(1, 1), (2, 0), (2, 0), (3, 1), (4, 0), (6, 1), (7, 1), (None, 1), (8, None), (8, 0), (8, 1)]
    for rows in (some, [(1, 1), (2, 1), (3, 1)], [(1, 0), (6, 0)], []):
        model = ranking.fit(docs, frame(spark, rows, "doc_id bigint, quality int"))
        got = ranking.classify(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert ranking.accepted(docs, model).columns == docs.columns
        assert ranking.accepted(docs, model).count() == sum(r.predicted for r in got)
    assert ranking.classify(docs.limit(0), model).count() == 0


def test_weights_equal_plain_gradient_descent_over_the_pairs():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.6, 1, (50, 4)) * [1, 2, 5, 1], rng.normal(0, 1, (23, 4)) * [1, 2, 5, 1]
    model = ranking.fit_pairs(good, bad)
    both = np.vstack([good, bad])
    assert np.allclose(model.mean, both.mean(0)) and np.allclose(model.scale, both.std(0))
    high, low = (good - both.mean(0)) / both.std(0), (bad - both.mean(0)) / both.std(0)
    pairs, stride = max(len(good), len(bad) * ranking.RIVALS), int(len(good) * 0.618) | 1
    met = [(k * stride + k // len(good), k) for k in range(pairs)]
    diff = np.array([high[a % len(good)] - low[b % len(bad)] for a, b in met])
    w = np.zeros(4)
    for _ in range(20_000):  # minus the gradient of mean(log(1 + exp(-diff w))) + 0.005 |w|^2
        w += 0.5 * (diff.T @ (1 / (1 + np.exp(diff @ w))) / pairs - 0.01 * w)
    assert np.allclose(model.weights, w, atol=1e-6)
    strengths = np.sort(np.concatenate([high @ w, low @ w]))
    assert (strengths < model.cutoff).sum() in (len(bad), len(bad) + 1)
    # a score over the threshold is a strength over the cutoff
    assert ((model.scores(both) >= ranking.THRESHOLD) == ((both - model.mean) / model.scale @ model.weights >= model.cutoff)).all()


def test_every_labelled_document_counts(spark):
    """More labelled documents than a block holds: the fit is that of all of them, whatever the blocks."""
    rng = np.random.default_rng(9)
    words = lambda k: " ".join("".join(rng.choice(list("abcdeXY9!.%"), rng.integers(1, 3 + k % 7))) for _ in range(rng.integers(3, 40)))
    rows = [(k, words(k)) for k in range(600)]
    for bad in (range(0, 600, 3), (11, 301)):  # many bad ones, and fewer than there are blocks
        bad = set(bad)
        kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
        labels = frame(spark, [(k, int(k not in bad)) for k, _ in rows], "doc_id bigint, quality int")
        found = {k: ranking.features(t.encode()) for k, t in kept}
        model = ranking.fit(frame(spark, rows), labels, rows=40)
        every = np.array(list(found.values()))
        assert np.allclose(model.mean, every.mean(0)) and np.allclose(model.scale, np.maximum(every.std(0), 1e-6))
        strength = (every - model.mean) / model.scale @ model.weights
        share = len(bad & found.keys()) / len(found)
        assert np.isclose(model.cutoff, np.quantile(strength, share))  # of all strengths, none left out
        whole = ranking.fit(frame(spark, rows), labels)  # one block: as held in one place
        twin = ranking.fit_pairs(*(np.array([x for k, x in found.items() if (k in bad) == b]) for b in (False, True)))
        assert np.allclose(whole.weights, twin.weights, atol=1e-6) and np.isclose(whole.cutoff, twin.cutoff, atol=1e-6)
