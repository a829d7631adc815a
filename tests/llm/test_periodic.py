import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainly.llm import periodic
from retainly.llm.queries import QUERIES

from .helpers import SMALL, awkward, frame


def plain(words):
    """All runs by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, change):
    words = [w for w in (text or "").encode().split()]
    if change and doc_id is not None:
        words = periodic.looped(words, zlib.crc32(str(doc_id).encode()))
    runs = plain(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def some(rng):
    kind = rng.randrange(5)
    few = [str(k) for k in range(rng.choice([1, 2, 3, 10, 200]))]
    words = [rng.choice(few) for _ in range(rng.randint(0, 150))]
    if kind == 1:  # repeated stretches, nested
        part = [rng.choice(few) for _ in range(rng.randint(1, 30))]
        part = part * rng.randint(1, 4) + [rng.choice(few)]
        words += part * rng.randint(2, 6) + part[: rng.randint(0, len(part))]
    if kind == 2:
        words += [rng.choice(few)] * rng.randint(5, 120) + words[:40]
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(3, 10)):  # Fibonacci words are full of runs
            a, b = b, b + a
        words += b
    return words


@pytest.mark.parametrize("pairs", [8, 0])
def test_all_runs_are_found(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)  # 0: every segment goes lag by lag
    rng = random.Random(pairs)
    for _ in range(60):
        texts = [some(rng) for _ in range(rng.randint(1, 8))]
        number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        words = np.array([number[w] for t in texts for w in t], np.int64)
        at = np.cumsum([0, *map(len, texts)])
        s, e, q = periodic.find(words, np.repeat(np.arange(len(texts)), np.diff(at)))
        got = list(zip(s.tolist(), (e - s).tolist(), q.tolist()))
        assert got == [(a + int(at[k]), n, p) for k, t in enumerate(texts) for a, n, p in plain(t)]


def test_looped_words():
    words = [str(k).encode() for k in range(40)]
    assert periodic.looped(words, 11) is words and periodic.looped([], 10) == []
    for g in (0, 3, 7, 39, 41, 10**8 + 5):
        n, a = 40, g % 40
        p = 1 + (n - a) // (3 + g % 8)
        assert periodic.looped(words, g * 10) == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect())
    want = sorted(plain_row(*r, True) for r in rows if len((r[1] or "").split()) < 3000)
    long = {r[0] for r in rows if len((r[1] or "").split()) >= 3000}
    assert [r for r in got if r[0] not in long] == want and sum(r[1] > 0 for r in want) > 10 and len(got) == len(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = periodic.digests(periodic.runs(docs))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(r.doc_id, r.text, False) for r in docs.collect() if len((r.text or "").split()) < 3000]
    got = [tuple(r) for r in found.collect() if r.doc_id not in (6, 7)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert found.count() == docs.count() and periodic.digests(periodic.runs(docs.limit(0))).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(1)
    once = [rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(30_000)]
    row = frame(spark, [(1, " ".join(["w"] * 100_000)), (2, " ".join(once * 3))])
    got = {r.doc_id: r for r in periodic.runs(row).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 100_000, 1)] and got[1].collapsed == "w"
    assert max(r.length for r in got[2].runs) == 90_000 and len(got[2].collapsed.split()) <= 30_000


def test_changed_texts_are_found_as_such(spark):
    docs = frame(spark, [(i, " ".join(f"w{k}" for k in range(60))) for i in range(300)])
    found = periodic.runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    assert {r.doc_id for r in found.where("size(runs) > 0").collect()} <= {i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0}
    assert found.where("size(runs) > 0").count() > 15
