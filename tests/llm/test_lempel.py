import hashlib
import random

import numpy as np
import pytest

from retainly.llm import lempel

from .helpers import awkward, frame, invented


def phrases(text):
    """LZ78 by the book, with strings."""
    found, at = set(), b""
    for c in text.encode():
        at += bytes([c])
        if at not in found:
            found.add(at)
            at = b""
    return found


def brute(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint) in descending order of doc_id."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: r[0], reverse=True)
    made = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        made.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), lempel.text_of(lempel.signature(t.encode())), lempel.text_of(lempel.signature(edited.encode())), after))
    return made


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_edited_and_next_texts(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.randint(-10**6, 10**6), invented(rng, rng.randint(0, 80)) + rng.choice(["", "é日", "x"])) for _ in range(70)]
    rows = list({d: t for d, t in rows}.items()) + [(10**7, None), (10**7 + 1, "")]
    got = {r.doc_id: r for r in lempel.edited_likeness(frame(spark, rows).repartition(5), ranges).collect()}
    assert len(got) == len(rows)
    for d, n, edited, own, theirs, after in brute(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, edited, own, theirs)
        assert r.near_next == lempel.likeness(sig(own), lempel.signature(after.encode()))
        assert r.near_edited == lempel.likeness(sig(own), sig(theirs))


def sig(text):
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def test_phrases_are_those_of_lz78():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 300)))
        parse = lempel.Parse().feed(text.encode())
        assert len(parse.hashes) - 1 == len(phrases(text)) and sorted(parse.sizes[1:]) == sorted(map(len, phrases(text)))


def test_back_restores_the_parse():
    parse = lempel.Parse().feed(b"abababab")
    place, before = parse.place(), (dict(parse.next), list(parse.hashes))
    parse.feed(b"qqqqqqqqq").back(place)
    assert (parse.next, parse.hashes) == before
    assert list(parse.feed(b"xyz").signature()) == list(lempel.signature(b"ababababxyz"))


def test_likeness_estimates_the_similarity_of_the_phrase_sets():
    rng = random.Random(3)
    off = []
    for _ in range(40):
        a = invented(rng, 400).split()
        b = a[: rng.randint(0, 400)] + invented(rng, rng.randint(1, 300)).split()
        x, y = ({p for p in phrases(" ".join(w)) if len(p) >= lempel.SHORT} for w in (a, b))
        off.append(lempel.likeness(*(lempel.signature(" ".join(w).encode()) for w in (a, b))) - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.08


def test_edges_of_likeness():
    one, none = lempel.signature(b"some text"), lempel.signature(b"")
    assert lempel.likeness(one, one) == 1 and lempel.likeness(none, none) == 1 and lempel.likeness(one, none) == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = lempel.edited_likeness(docs, 4).collect()
    assert sorted((repr(r.doc_id), r.n_chars) for r in got) == sorted((repr(r.doc_id), len(r.text or "")) for r in docs.collect())
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1  # equal texts
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert lempel.edited_likeness(docs.limit(0)).count() == 0
    alone = lempel.edited_likeness(frame(spark, [(1, "alone here and long")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert lempel.fingerprints(docs).count() == docs.count()


def test_short_texts_are_compared_by_all_phrases():
    """Two thirds equal, and up to some 30 phrases each: the likeness is that of the whole sets, and never 0."""
    rng = random.Random(4)
    for n in range(40):
        text, other = (invented(rng, 8 + n)[: 50 + 5 * n] for _ in range(2))
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        x, y = phrases(text), phrases(edited)
        got = lempel.likeness(*(lempel.signature(t.encode()) for t in (text, edited)))
        assert got > 0 and (len(x | y) > lempel.SIZE or abs(got - len(x & y) / len(x | y)) < 1e-9)


def test_a_long_phrase_does_not_hide_the_short_ones():
    short, longer = b"abcdefgh", b"abcdefgh" + b"ababcabcd"
    x, y = phrases(short.decode()), phrases(longer.decode())
    assert max(map(len, x)) < 4 <= max(map(len, y))
    assert lempel.likeness(lempel.signature(short), lempel.signature(longer)) == len(x & y) / len(x | y)
