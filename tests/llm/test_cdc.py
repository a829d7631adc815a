import random

from retainly.llm import cdc

from .helpers import awkward, frame, invented


def brute(rows, min_bytes=cdc.MIN_BYTES):
    """(doc_id, kept text) by following the definition chunk by chunk."""
    order = lambda d: -(2**63) if d is None else d
    have = {}
    for d, text in rows:
        t = (text or "").encode()
        ends = cdc.cuts(t)
        for a, b in zip([0, *ends], ends):
            have.setdefault(t[a:b], []).append(order(d))
    made = []
    for d, text in rows:
        t = (text or "").encode()
        ends = cdc.cuts(t)
        seen, kept, run = set(), b"", b""
        for a, b in zip([0, *ends], ends):
            chunk = t[a:b]
            if chunk in seen or min(have[chunk]) < order(d):
                run += chunk
            else:
                kept += (b"" if len(run) >= min_bytes else run) + chunk
                run = b""
            seen.add(chunk)
        kept += b"" if len(run) >= min_bytes else run
        made.append((d, kept.decode()))
    return made


def test_matches_brute_force_and_catches_passages(spark):
    rng = random.Random(2)
    passage = invented(rng, 60)
    texts = [invented(rng, rng.randint(5, 300)) for _ in range(40)]
    rows = []
    for i, t in enumerate(texts):
        words = t.split()
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            t = " ".join([*words[:at], passage, *words[at:]])
        rows.append((i, t))
    rows += [(100, texts[1]), (101, texts[2] + " " + texts[2])]
    docs = frame(spark, rows)
    want = brute(rows)
    got = {r.doc_id: r.text for r in cdc.deduplicated(docs).collect()}
    assert got == dict(want)
    spans = {r.doc_id: r for r in cdc.spans(docs).collect()}
    assert all(spans[d].n_removed == len(t.encode()) - len(got[d].encode()) for d, t in rows)
    assert all((spans[i].n_removed >= 100) == (i > 0) for i in range(0, 40, 4))  # the first stays
    assert all(spans[i].n_removed == 0 for i in range(40) if i % 4)  # clean documents are left alone
    assert got[100] == ""


def test_cuts_resist_insertions():
    rng = random.Random(7)
    text = invented(rng, 500).encode()
    shifted = text[:1000] + b"inserted here " + text[1000:]
    chunks = lambda t: {t[a:b] for a, b in zip([0, *cdc.cuts(t)], cdc.cuts(t))}
    assert len(chunks(text) - chunks(shifted)) <= 3


def test_cuts_cover_the_text_at_characters():
    for text in ("x" * 50_000, "一二三四五" * 4000, "", " ", "a b  c\n" * 900):
        t = text.encode()
        ends = cdc.cuts(t)
        assert (ends[-1] if ends else 0) == len(t) and ends == sorted(set(ends))
        for a, b in zip([0, *ends], ends):
            t[a:b].decode()


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = cdc.deduplicated(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    key = lambda r: (repr(r[0]), r[1] or "")
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=key) == sorted(brute(rows), key=key)
    assert sum(r.text is None for r in got.collect()) == 2
    assert cdc.spans(docs).count() == docs.count()
    assert cdc.spans(docs.limit(0)).count() == 0 and cdc.deduplicated(docs.limit(0)).count() == 0


def unspaced(rng, n, kind):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") if kind == "ascii" else chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))


def test_passages_without_spaces_are_found_in_paragraphs_of_any_length(spark):
    rng = random.Random(11)
    for kind in ("cjk", "ascii"):
        passage, rows = unspaced(rng, 300, kind), []
        for k, n in enumerate((0, 10, 40, 100, 300, 1200)):  # characters before and after the passage
            rows.append((k, "a few words " + unspaced(rng, n, kind) + passage + unspaced(rng, n // 2, kind) + " and more"))
        rows.append((99, unspaced(rng, 900, kind)))
        got = {r.doc_id: r for r in cdc.spans(frame(spark, rows)).collect()}
        size = len(passage.encode())
        assert got[0].n_removed == got[99].n_removed == 0
        assert all(got[k].n_removed > 0.6 * size for k in range(1, 6)), (kind, [got[k].n_removed for k in range(6)], size)


def test_cuts_without_spaces_do_not_depend_on_the_gap():
    rng = random.Random(12)
    passage, ends = unspaced(rng, 300, "cjk").encode(), []
    for n in (0, 30, 260, 500):
        before = unspaced(rng, n, "cjk").encode()
        own = [e - len(before) for e in cdc.cuts(before + passage + b" and more words")]
        ends.append([e for e in own if cdc.WINDOW <= e <= len(passage)])
    assert all(e == ends[0] for e in ends) and len(ends[0]) > 10
