import hashlib
import random

import numpy as np
import pytest

from retainly.llm import suffixes

from .helpers import awkward, frame, invented

W = suffixes.WINDOW


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text), window by window."""
    order = lambda d: -(2**63) if d is None else d
    texts = [(order(d), k, d, (t or "").encode()) for k, (d, t) in enumerate(rows)]
    first = {}
    for o, k, _, t in sorted(texts, key=lambda x: (x[0], x[1])):
        for p in range(len(t) - W + 1):
            first.setdefault(t[p : p + W], (o, k, p))
    made = []
    for o, k, d, t in texts:
        gone = np.zeros(len(t) + W, int)
        for p in range(len(t) - W + 1):
            fo, fk, fp = first[t[p : p + W]]
            if fo < o or (fk == k and fp < p):
                gone[p : p + W] = 1
        gone = gone[: len(t)]
        kept = bytes(c for c, g in zip(t, gone) if not g)
        made.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return made


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


def repeats(rng):
    passages = [invented(rng, rng.randint(15, 80)) for _ in range(6)]
    rows = []
    for d in range(60):
        words = invented(rng, rng.randint(0, 150)).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            p = rng.choice(passages)
            words[at:at] = [p[rng.randint(0, 30) :] if rng.random() < 0.5 else p]
        rows.append((rng.randint(0, 10**6), " ".join(words)))
    for d, t in rows[:10]:  # near copies
        words = t.split() or ["x"]
        words[rng.randrange(len(words))] = "changed"
        rows.append((d + 10**7, " ".join(words)))
    rows += [(2 * 10**7, "ab" * 400), (2 * 10**7 + 1, "ab" * 300 + "c" * 300), (2 * 10**7 + 2, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = repeats(random.Random(seed))
    got = suffixes.kept(frame(spark, rows)).collect()
    assert sorted_rows(got) == sorted_rows(brute(rows))


def test_edges_and_long_runs_are_compared_across_buckets(spark, monkeypatch):
    rows = repeats(random.Random(3))
    monkeypatch.setattr(suffixes, "ROWS", 3)  # many small buckets: most runs reach an edge
    got = suffixes.kept(frame(spark, rows).repartition(5)).collect()
    assert sorted_rows(got) == sorted_rows(brute(rows))


def test_whole_gives_texts_and_spans(spark):
    rows = repeats(random.Random(4))[:20]
    for r, (d, t) in zip(sorted(suffixes.kept(frame(spark, rows), whole=True).collect()), sorted(rows)):
        text, kept, at = t.encode(), b"", 0
        for s in r.spans:
            kept += text[at : s.start]
            at = s.end
        assert kept + text[at:] == bytes(r.kept) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_multikey_sort_sorts_strings():
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(500)]
    order = suffixes.multikey_sort(suffixes.tokens_of(strings, 40))
    assert [strings[k] for k in order] == sorted(strings)


def test_anchors_own_every_window_once():
    rng = random.Random(6)
    texts = [invented(rng, n).encode() for n in (0, 3, 30, 200, 1)] + [b"z" * 1000]
    start, n, place, _, _, doc = suffixes.anchors(b"".join(texts), np.array([len(t) for t in texts]))
    windows = {p for a, k in zip(start.tolist(), n.tolist()) for p in range(a, a + k)}
    begin = np.cumsum([0] + [len(t) for t in texts])
    assert windows == {b + p for b, t in zip(begin.tolist(), texts) for p in range(len(t) - W + 1)} and n.sum() == len(windows)
    assert ((place >= start + n - 1) & (place + suffixes.GRAM <= start + W)).all()


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted_rows(suffixes.kept(docs).collect()) == sorted_rows(brute(rows))
    assert suffixes.kept(docs.limit(0)).count() == 0
    assert suffixes.kept(frame(spark, [(1, "short"), (2, "short")])).count() == 2


def test_anchors_spread_over_all_parts(spark):
    """An anchor's hash is small, being the smallest around; the parts that meet by it have to be even all the same."""
    rng = random.Random(8)
    sizes = np.array([3000] * 40)
    _, _, _, gram, _, _ = suffixes.anchors(b"".join(invented(rng, 800).encode()[:3000].ljust(3000) for _ in sizes), sizes)
    parts = np.bincount(((gram * suffixes._ODD >> np.uint64(32)) * np.uint64(16) >> np.uint64(32)).astype(int), minlength=16)
    assert parts.max() < 2 * parts.mean()


def test_stretches_of_one_anchor_are_told_apart_by_more_than_32_bits(spark):
    """Among the stretches of one anchor string the anchor's hash says nothing."""
    rng = np.random.default_rng(9)
    letters = rng.integers(97, 123, 200_000, np.uint8)
    low = int(np.argmin(suffixes.gram_hashes(letters)))
    texts = rng.integers(97, 123, (400_000, W), np.uint8)
    texts[:, 34 : 34 + suffixes.GRAM] = letters[low : low + suffixes.GRAM]
    seen, pairs = {}, []
    for t in map(bytes, texts):
        other = seen.setdefault(suffixes.xxhash.xxh32_intdigest(t), t)
        if other != t:
            pairs.append((other, t))
    grams = [suffixes.anchors(b"".join(p), np.array([W, W]))[3] for p in pairs]
    a, b = next(p for p, g in zip(pairs, grams) if len(g) == 2 and g[0] == g[1])
    rows = [(1, a.decode()), (2, b.decode())]
    assert sorted_rows(suffixes.kept(frame(spark, rows)).collect()) == sorted_rows(brute(rows))
    assert sorted_rows(suffixes.kept(frame(spark, rows).repartition(2)).collect()) == sorted_rows(brute(rows))


def accented(rng, n_words):
    return "".join(rng.choice(["é", "ü", "日", "本", "語", "я", "a", "b", "c", " "]) for _ in range(4 * n_words))


@pytest.mark.parametrize("seed", [10, 11])
def test_edges_of_accented_and_cjk_text_are_compared_across_buckets(spark, monkeypatch, seed):
    """Tokens that begin with a byte from 0x80 on are the largest, not negative."""
    rng = random.Random(seed)
    monkeypatch.setitem(globals(), "invented", accented)
    rows = repeats(rng)
    monkeypatch.setattr(suffixes, "ROWS", 40)
    got = suffixes.kept(frame(spark, rows).repartition(5)).collect()
    assert sorted_rows(got) == sorted_rows(brute(rows))
    monkeypatch.setattr(suffixes, "ROWS", 3)
    got = suffixes.kept(frame(spark, rows).repartition(5)).collect()
    assert sorted_rows(got) == sorted_rows(brute(rows))


def test_tokens_are_ordered_as_their_bytes(spark):
    """The first and last run of a bucket are those at the edges of its range."""
    rng = random.Random(13)
    passages = [accented(rng, 12) for _ in range(40)]
    docs = frame(spark, [(k, "".join(rng.sample(passages, 30))) for k in range(6)])
    suffixes.prepare(spark)
    packs = suffixes.packs_of(docs)
    rows = suffixes.suffixes(packs, suffixes.stretches(packs, 4)).collect()
    grams = {(r.t0, r.t1, r.t2, r.t3): bytes(r.bytes)[r.place : r.place + suffixes.GRAM] for r in rows}
    assert len(grams) > 4 and [grams[t] for t in sorted(grams)] == sorted(grams.values())
    assert {g[0] >= 0x80 for g in grams.values()} == {True, False}


@pytest.mark.parametrize("rows_a_bucket", [suffixes.ROWS, 3])
def test_equal_packs_stay_apart(spark, monkeypatch, rows_a_bucket):
    """Rows of one doc_id are not earlier than each other: each copy of a table loses what it would lose alone."""
    rng = random.Random(14)
    rows = repeats(rng)
    phrase = invented(rng, 9)
    rows += [(3 * 10**7 + k, invented(rng, 30) + phrase + invented(rng, 30) + phrase[k:] + invented(rng, 5)) for k in range(8)]
    rows = list({d: (d, t) for d, t in rows}.values())
    monkeypatch.setattr(suffixes, "PACK", 300)
    monkeypatch.setattr(suffixes, "ROWS", rows_a_bucket)
    docs = frame(spark, rows).repartition(3, "doc_id")
    got = suffixes.kept(docs.union(docs)).collect()
    assert sorted_rows(got) == sorted_rows(2 * brute(rows))


def near_copies(rng, n):
    words = invented(rng, 60).split()
    return [(d, " ".join([*words[: 20 + d % 20], f"changed{d}", *words[21 + d % 20 :]])) for d in range(n)]


def test_only_long_anchors_are_compared_across_buckets(spark, monkeypatch):
    rows = near_copies(random.Random(6), 120) + repeats(random.Random(7))
    want = sorted_rows(brute(rows))
    for most, opened in ((suffixes.LONG_RUN, False), (20, True)):
        monkeypatch.setattr(suffixes, "LONG_RUN", most)
        assert sorted_rows(suffixes.kept(frame(spark, rows)).collect()) == want
        packs = suffixes.packs_of(frame(spark, rows))
        open_rows = suffixes.suffixes(packs, suffixes.stretches(packs, 8))
        made = suffixes.sorted_buckets(open_rows, 40)
        assert bool(made.where("w1 is not null").count()) == opened
