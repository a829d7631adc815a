import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from retainly.llm import hmm

from .helpers import awkward, frame

END = object()


def tokens(text):
    return bytes((text or "").encode()).lower().split() + [END]


def base_scores(rows):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    count = Counter(w for d, t in rows if not held[d] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    made = []
    for d, t in rows:
        words = tokens(t)
        made.append((d, held[d], len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    return made, count


def corpus(rng, n=80):
    languages = [["aa", "ab", "ac", "ad", "ae"], ["ba", "bb", "bc", "bd"], ["ca", "CB", "cc"]]
    return [(d, " ".join(rng.choice(languages[d % 3]) + rng.choice(["", "", "x", "y"]) for _ in range(rng.randint(0, 40)))) for d in range(n)]


def test_base_score_and_counts_match_brute_force(spark):
    rows = corpus(random.Random(1))
    got = {r.doc_id: r for r in hmm.scores(frame(spark, rows), steps=2).collect()}
    want, _ = base_scores(rows)
    for d, held, n, known, total, base in want:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-9)


def test_the_model_beats_the_unigram_base_on_held_out_texts(spark):
    rows = corpus(random.Random(2), 300)
    got = [r for r in hmm.scores(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def together(sequences):
    return hmm.Group(np.concatenate(sequences), np.array([len(s) for s in sequences]))


def small_model(rng, states=3, classes=4):
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, classes))).T)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    model = small_model(rng)
    sequences = [rng.integers(0, 4, n) for n in (1, 2, 5, 3, 5)]
    got = together(sequences).likelihoods(model)
    for s, x in zip(sequences, got):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert x == pytest.approx(math.log10(total), abs=1e-12)


def test_expected_counts_are_those_of_all_paths():
    rng = np.random.default_rng(4)
    model = small_model(rng)
    sequences = [rng.integers(0, 4, n) for n in (4, 1, 3)]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s in sequences:
        paths = list(itertools.product(range(3), repeat=len(s)))
        chance = []
        for path in paths:
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            chance.append(p)
        for path, p in zip(paths, np.array(chance) / sum(chance)):
            starts[path[0]] += p
            for t in range(len(s)):
                emits[s[t], path[t]] += p
                if t:
                    moves[path[t - 1], path[t]] += p
    got = together(sequences).expected(model)
    for a, b in zip(got, (starts, moves, emits)):
        assert np.allclose(a, b)


def test_training_raises_the_likelihood(spark):
    rows = corpus(random.Random(5), 120)
    packs = hmm.packed(frame(spark, rows))
    _, count = base_scores(rows)
    n_of = np.zeros(hmm.CLASSES + 1)
    for w, c in count.items():
        n_of[hmm.CLASSES if w is END else hmm.word_class(w)] += c
    shares = (n_of + 0.1) / (n_of.sum() + 0.1 * len(n_of))
    sequences = [np.array([hmm.word_class(w) for w in tokens(t)[:-1]] + [hmm.CLASSES]) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    found = [together(sequences).likelihoods(hmm.train(packs, shares, steps)).sum() for steps in (0, 1, 3)]
    assert found[0] < found[1] < found[2]


def test_scores_are_a_distribution(spark):
    """All texts of up to two words of a tiny vocabulary, unknown words as one, sum to the chance of so short a text."""
    rows = [(d, t) for d, t in enumerate(["a b", "a", "b b", "", "a a", "b a", "a b", "b", "", "a"])]
    docs = [(1000 + k, " ".join(x)) for n in range(3) for k, x in enumerate(itertools.product(["a", "b", "q"], repeat=n), 10 * n)]
    held = [(d * 10**6 + j, t) for d, t in docs for j in range(200) if zlib.crc32(str(d * 10**6 + j).encode()) % 10 == 0][: 10**4]
    one = {}
    for d, t in held:
        one.setdefault(t, (d, t))
    got = {r.doc_id: r.score for r in hmm.scores(frame(spark, rows + list(one.values()))).collect()}
    assert 0.05 < sum(10 ** got[d] for d, _ in one.values()) <= 1 + 1e-9


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = hmm.scores(docs, steps=1).collect()
    key = lambda x: tuple(map(repr, x[:5]))
    assert sorted((key(r) for r in got)) == sorted(key(w) for w in base_scores(rows)[0])
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.scores(docs.limit(0)).count() == 0
    alone = hmm.scores(frame(spark, [(d, "no training text") for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0])).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in alone)


def test_word_model_matches_a_twin_on_one_machine(spark, monkeypatch):
    """Packs and slices of few tokens; emissions, masses and scores again by plain loops from the same trained states."""
    monkeypatch.setattr(hmm, "SLICE", 60)
    rows = corpus(random.Random(9), 90)
    docs = frame(spark, rows)
    packs = hmm.packed(docs)
    got = {r.doc_id: r.score for r in hmm.scores(docs, steps=2).collect()}
    _, count = base_scores(rows)
    bytes_of = {w: hmm.END if w is END else w for w in count}
    n_of = np.zeros(hmm.CLASSES + 1)
    for w, c in count.items():
        n_of[hmm.word_class(bytes_of[w])] += c
    assert (hmm.class_counts(packs) == n_of).all()
    model = hmm.train(packs, (n_of + 0.1) / (n_of.sum() + 0.1 * len(n_of)), 2)
    expected = {w: np.zeros(hmm.STATES) for w in count}
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10 == 0:
            continue
        seq = tokens(t)
        emit = [model.emit[hmm.word_class(bytes_of[w])] for w in seq]
        ahead, back = [model.start * emit[0]], [np.ones(hmm.STATES)]
        for e in emit[1:]:
            ahead.append((ahead[-1] @ model.move) * e)
        for e in emit[:0:-1]:
            back.insert(0, model.move @ (e * back[0]))
        for w, a, b in zip(seq, ahead, back):
            expected[w] += a * b / (a @ b)
    overall = np.linalg.matrix_power(model.move, 1 << 10).mean(0)
    mass = {}
    for w, e in expected.items():
        share = np.clip(np.round(255 * (e + hmm.LEAN * overall) / (e.sum() + hmm.LEAN)), 1, None)
        mass[w] = (count[w] + 0.1) * share / share.sum()
    whole = sum(mass.values()) + 0.1 * overall
    for d, t in rows:
        p, total = model.start, 0.0
        for k, w in enumerate(tokens(t)):
            p = (p @ model.move if k else p) * mass.get(w, 0.1 * overall) / whole
            total, p = total + math.log10(p.sum()), p / p.sum()
        # shares are kept in 255 steps and counts in 64 parts, so that a step may differ by rounding
        assert got[d] == pytest.approx(total, abs=0.02 * len(tokens(t)))


def test_a_state_emits_a_distribution_and_a_table_loaded_twice_counts_twice(spark):
    rows = corpus(random.Random(12), 60)
    docs = frame(spark, rows)
    packs = hmm.packed(docs)
    model = hmm.train(packs, np.full(hmm.CLASSES + 1, 1 / (hmm.CLASSES + 1)), 1)
    overall = np.full(hmm.STATES, 1 / hmm.STATES)
    words = hmm.emissions(packs, model, overall)
    table = words.toPandas()
    _, count = base_scores(rows)
    assert dict(zip(table.word, table.uses)) == {hmm.END if w is END else w: c for w, c in count.items()}
    by_state = hmm.masses(table.uses.to_numpy(), table["mix"].to_numpy())
    assert np.allclose(by_state.sum(0) + hmm.ADD * overall, hmm.state_masses(words, overall))
    twice = hmm.scores(docs.union(docs), steps=1).collect()
    want, _ = base_scores(rows + rows)
    key = lambda x: tuple(map(repr, x[:5]))
    assert sorted(map(key, twice)) == sorted(map(key, want))


def test_words_by_state_tell_topics_apart(spark):
    """Rare words, each in texts of one topic: far better than the base on held-out texts, where buckets can't be."""
    rng = random.Random(21)
    topics = [[f"{c}{k}" for k in range(400)] for c in "abc"]
    rows = [(d, " ".join(rng.choices(topics[d % 3], k=30))) for d in range(400)]
    got = [r for r in hmm.scores(frame(spark, rows)).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.15  # log10(3) = 0.48 at best
