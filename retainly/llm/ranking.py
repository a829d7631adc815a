"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text, and the chance
that a good document is preferred to a bad one is the logistic function of the
difference of their strengths. Weights are fitted by logistic loss on feature
differences of preference pairs (Newton steps with a ridge); the cutoff is the
quantile of strengths that leaves as large a share below as the training
labels call bad. The score is the logistic function of the strength, moved so
that the cutoff gets THRESHOLD.

The fit reads every labelled document that isn't held out. They are dealt by
hash into blocks of some ROWS documents, each kept as one row of features; a bad
document meets RIVALS good ones of its block, and every good one meets a bad one.
A kind that is too rare for that is dealt by number, and repeated if there are
fewer of it than blocks. Each Newton step is a pass over the blocks, from which
only sums come back. Features are counts over the text's bytes and words, so
null and empty texts have features too (all zero) and one memory bound holds for
any length. Repeated labels of a document count by their mean, labels or doc_ids
that are null are left out; with labels of one kind only, the score is the share
of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import exact_quantiles
from .common import body, prepare, saved

THRESHOLD = 0.3
ROWS = 20_000  # labelled documents of a block
RIVALS = 16  # good documents that each bad one is compared with
RARE = 64  # a kind with fewer documents a block is dealt by number, as a hash might leave a block without it


def _kinds() -> np.ndarray:
    """Byte classes, one column each."""
    rules = [str.isupper, str.islower, str.isdigit, lambda c: c == " ", lambda c: c in "\t\n\x0b\x0c\r", lambda c: c in ".,;:'\"?-()", lambda c: c == "!"]
    table = np.zeros((256, len(rules) + 2))
    for b in range(128):
        found = [k for k, rule in enumerate(rules) if rule(chr(b))]
        table[b, found[0] if found else len(rules)] = 1  # other signs of ASCII
    table[128:, len(rules) + 1] = 1
    return table


KINDS = _kinds()


def features(text: bytes) -> list[float]:
    """Shares of byte classes, word shapes and repetition, and sizes."""
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ KINDS / max(1, len(text))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    distinct = len(set(words)) / n if words else 0.0
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if words else 0.0
    return [
        *share, *np.sqrt(share),
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(text) / n),
        distinct, pairs, distinct * math.log1p(n), pairs * math.log1p(n),
        len(set(lines)) / len(lines) if lines else 0.0,
        math.log1p(len(words) / max(1, len(lines))),
    ]


def features_of(column: str) -> Column:
    @F.pandas_udf("array<double>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(bytes(t)))

    return found(column)


@dataclass(frozen=True)
class Model:
    """strength = (features - mean) / scale * weights"""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cutoff: float
    constant: float | None = None

    def scores(self, found: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(found), self.constant)
        strength = (found - self.mean) / self.scale @ self.weights - self.cutoff
        return 1 / (1 + np.exp(-np.clip(strength + math.log(THRESHOLD / (1 - THRESHOLD)), -700, 700)))


def differences(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Feature differences of the pairs: each bad row meets RIVALS good ones, and each good row a bad one."""
    k = np.arange(max(len(good), len(bad) * RIVALS))
    step = max(1, int(len(good) * 0.618)) | 1
    return good[(k * step + k // max(1, len(good))) % len(good)] - bad[k % len(bad)]


def slopes(diff: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs' log likelihood: gradient and curvature, summed."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))  # chance that the pair is called the wrong way
    return diff.T @ p, (diff * (p * (1 - p))[:, None]).T @ diff


def newton(summed, width: int, ridge: float, steps: int) -> np.ndarray:
    """Weights by Newton steps; summed(w): gradient and curvature over all pairs, and their number."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, curve, pairs = summed(w)
        move = np.linalg.solve(curve / pairs + ridge * np.eye(width), gradient / pairs - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def constant(good: int, bad: int, width: int) -> Model:
    """The model of labels of one kind, or of none."""
    return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, (1.0 if good else 0.0) if good + bad else 0.5)


def fit_pairs(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> Model:
    """Bradley-Terry weights from feature rows of preferred and of other documents: fit() on one block held in one place."""
    both = np.vstack([good, bad])
    if not len(good) or not len(bad):
        return constant(len(good), len(bad), both.shape[1] if both.ndim == 2 else 0)
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    good, bad = (good - mean) / scale, (bad - mean) / scale
    diff = differences(good, bad)
    w = newton(lambda w: (*slopes(diff, w), len(diff)), diff.shape[1], ridge, steps)
    strengths = np.concatenate([good @ w, bad @ w])
    return Model(mean, scale, w, float(np.quantile(strengths, len(bad) / len(strengths))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def blocks_of(rows: DataFrame, counts: dict[bool, int], size: int) -> DataFrame:
    """rows (doc_id, good, found) -> one row a block: block, good, bad (features of its documents, doubles end to end), own_good, own_bad
    (how many of them, the first, are in no block before)."""
    blocks = max(1, math.ceil(sum(counts.values()) / size))
    dealt = []
    for good, n in counts.items():
        kind = rows.where(F.col("good") == good)
        if n < RARE * blocks:
            number = F.row_number().over(Window.orderBy("doc_id")) - 1  # fewer than RARE rows a block
            each = F.sequence((number % blocks).cast("int"), F.lit(blocks - 1), F.lit(min(n, blocks)))
            dealt.append(kind.withColumn("in", each).select("*", F.posexplode("in").alias("copy", "block")).drop("in"))
        else:
            dealt.append(kind.select("*", F.lit(0).alias("copy"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")))

    def packed(table):
        found = np.asarray(table.column("found").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        good, copy, ids = (np.array(table.column(c).to_pylist()) for c in ("good", "copy", "doc_id"))
        by = np.lexsort((ids, copy))
        parts = [found[by[good[by] == g]].tobytes() for g in (True, False)]
        own = [int(((copy == 0) & (good == g)).sum()) for g in (True, False)]
        return pa.table([table.column("block").slice(0, 1), *([x] for x in (*parts, *own))], schema=pa.schema([
            ("block", pa.int32()), ("good", pa.binary()), ("bad", pa.binary()), ("own_good", pa.int64()), ("own_bad", pa.int64())]))

    schema = "block int, good binary, bad binary, own_good bigint, own_bad bigint"
    return dealt[0].unionByName(dealt[1]).groupBy("block").applyInArrow(packed, schema)


def over_blocks(packs: DataFrame, width: int, parts) -> list[np.ndarray]:
    """Sums over all blocks of the arrays that parts(good, bad, own_good, own_bad) gives; one row a task comes to the driver."""

    def mapped(batches):
        total = None
        for b in batches:
            for good, bad, own_good, own_bad in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows = [np.frombuffer(x).reshape(-1, width) for x in (good, bad)]
                made = [np.atleast_1d(np.asarray(x, np.float64)) for x in parts(*rows, own_good, own_bad)]
                total = made if total is None else [x + y for x, y in zip(total, made)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[x.ravel().tolist() for x in total]], pa.list_(pa.list_(pa.float64())))], names=["sums"])

    found = packs.select("good", "bad", "own_good", "own_bad").mapInArrow(mapped, "sums array<array<double>>").collect()
    return [sum(np.array(r.sums[k]) for r in found) for k in range(len(found[0].sums))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, ridge: float = 1e-2, steps: int = 30) -> Model:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...): the model, from all rows that aren't held out; rows: of a block."""
    prepare(docs.sparkSession)
    ours = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marked = (labels.where(F.col("quality").isNotNull() & ours)
              .groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).alias("good")))
    # features are a tenth of a text: they meet the labels, so that no text moves
    met = docs.where(ours).select("doc_id", body().alias("body")).select("doc_id", features_of("body").alias("found")).join(marked, "doc_id")
    met = saved(met.groupBy("doc_id", "good").agg(F.min("found").alias("found")), "ranking-rows")
    count = {r.good: r["count"] for r in met.groupBy("good").count().collect()}
    good, bad = count.get(True, 0), count.get(False, 0)
    width = len(features(b""))
    if not good or not bad:
        return constant(good, bad, width)
    packs = saved(blocks_of(met, {True: good, False: bad}, rows), "ranking-blocks")
    own = lambda g, b, m, n: np.vstack([g[:m], b[:n]])
    mean = over_blocks(packs, width, lambda *x: [own(*x).sum(0)])[0] / (good + bad)
    scale = np.maximum(np.sqrt(over_blocks(packs, width, lambda *x: [((own(*x) - mean) ** 2).sum(0)])[0] / (good + bad)), 1e-6)

    def summed(w):
        def parts(g, b, *_):
            diff = differences((g - mean) / scale, (b - mean) / scale)
            return *slopes(diff, w), len(diff)

        gradient, curve, pairs = over_blocks(packs, width, parts)
        return gradient, curve.reshape(width, width), pairs[0]

    w = newton(summed, width, ridge, steps)

    def strengths(batches):
        for batch in batches:
            for g, b, m, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x = own(*(np.frombuffer(x).reshape(-1, width) for x in (g, b)), m, n)
                yield pa.RecordBatch.from_arrays([pa.array((x - mean) / scale @ w)], names=["strength"])

    found = packs.select("good", "bad", "own_good", "own_bad").mapInArrow(strengths, "strength double")
    return Model(mean, scale, w, float(exact_quantiles(found, "strength", [bad / (good + bad)]).first()[0]))


def score(model: Model, text: Column) -> Column:
    """The score of a text column, from 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(bytes(t)) for t in texts]).reshape(len(texts), -1)))

    return scored(F.coalesce(text, F.lit("")).cast("binary"))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> doc_id, held_out, score, predicted (1 if score >= THRESHOLD, else 0); one row for each row of docs."""
    prepare(docs.sparkSession)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, with their columns."""
    prepare(docs.sparkSession)
    return docs.where(score(model, F.col("text")) >= THRESHOLD)
