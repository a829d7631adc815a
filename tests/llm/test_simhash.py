import random

import numpy as np
import xxhash

from retainly.llm import graph, simhash

from .helpers import awkward, frame, invented


def brute_fingerprint(text):
    words = bytes((text or "").encode()).lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """doc_id -> smallest doc_id reachable; rows (doc_id, text)."""
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, format(fps[i], "016x"), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def near_copies(rng):
    base = [invented(rng, rng.randint(60, 400)) for _ in range(12)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(rng.randint(0, 12)):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    return texts + ["", None, "one", "One", "two words"]


def test_fingerprints_and_groups_match_brute_force(spark):
    texts = near_copies(random.Random(1))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(rows))


def test_every_plan_finds_every_link(spark):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, *(fps ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) for _ in range(4))]))
    df = frame(spark, [(int(x),) for x in fps.view(np.int64)], "fp bigint")
    want = brute_components(fps, 4)
    for n in (100, 1_000_000, 10**9, 10**12):  # other sizes, other plans
        planned = simhash.plan(fps[:200], n, 4)
        found = [pair for part, (mask, t) in enumerate(planned) for pair in met(fps, mask, t)]
        assert components_of(fps, found) == want
    links = [(np.uint64(r.a & (2**64 - 1)), np.uint64(r.b & (2**64 - 1))) for r in simhash.links(df, 4).collect()]
    assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in links)
    assert components_of(fps, links) == want


def met(fps, mask, t):
    by = {}
    for values, own in simhash._filed(fps, mask, t):
        for v, x in zip(values.tolist(), own.tolist()):
            by.setdefault(v, []).append(x)
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if a != b and (a ^ b).bit_count() <= 4:
                    yield a, b


def brute_components(fps, d):
    return components_of(fps, [(a, b) for i, a in enumerate(fps.tolist()) for b in fps.tolist()[:i] if (a ^ b).bit_count() <= d])


def components_of(fps, pairs):
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(int(a)), find(int(b))
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


def test_parts_cover_all_bits_once():
    sample = np.random.default_rng(2).integers(0, 2**64, 300, dtype=np.uint64)
    for m in range(1, 6):
        masks = simhash.parts_of(sample, m)
        assert sum(masks) == 2**64 - 1 and len(masks) == m
        assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])


def test_hot_values_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 500)
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**63))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (4000, 2))}
    df = frame(spark, [(x,) for x in fps], "fp bigint")
    links = [(r.a, r.b) for r in simhash.links(df, 4).collect()]
    assert len(set(components_of(np.array(sorted(fps)), links).values())) == 1
    assert len(links) < len(fps) ** 2 / 8  # not all pairs


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    links = chain + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (3, 2), (-4, 200)]
    got = {r.node: r.root for r in graph.components(frame(spark, links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[200] == -4
    assert graph.components(frame(spark, [], "a bigint, b bigint")).count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(brute_groups([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(ids)) and set(ids) == {c for _, _, c in got if c is not None}
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0
