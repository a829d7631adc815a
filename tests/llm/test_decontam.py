import random

from retainly.llm import decontam

from .helpers import awkward, frame, invented

BENCH = "item_id bigint, text string"


def brute_matches(docs, items):
    """Every item that a document holds by shingles alone, whatever its BM25 score."""
    found = set()
    for d, text in docs:
        have = {tuple(w) for n in (1, 2, 3, 4, 5) for w in runs(text or "", n)}
        for i, item in items:
            words = (item or "").encode().lower().split()
            line = (item or "").encode().find(b"\n")
            cut = (len((item or "").encode()[:line].split()) if line >= 0 else len(words) // 2) or len(words) // 2
            parts = [decontam.grams(words, 5), decontam.grams(words[:cut], 5), decontam.grams(words[cut:], 5)]
            share = [sum(g in have for g in p) / len(p) if p else 1.0 for p in parts]
            if words and share[0] >= 0.8 and min(share[1:]) >= 0.5:
                found.add((d, i))
    return found


def runs(text, n):
    words = text.encode().lower().split()
    return (words[k : k + n] for k in range(len(words) - n + 1))


def planted(rng):
    items = [(i, invented(rng, rng.randint(15, 60)) + ("\n" + invented(rng, 12) if i % 2 else "")) for i in range(40)]
    items += [(90, "the of"), (91, ""), (92, None)]
    docs = []
    for d in range(120):
        text = invented(rng, rng.randint(1, 700))
        if d % 3 == 0:
            words = text.split()
            at = rng.randint(0, len(words))
            item = items[rng.randrange(40)][1]
            if d % 6 == 0:
                item = item.upper()
            text = " ".join([*words[:at], item, *words[at:]])
        elif d % 3 == 1:  # half of an item: not contaminated
            text += " " + " ".join(items[d % 40][1].split()[:7])
        docs.append((d, text))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = planted(random.Random(4))
    got = decontam.contaminated(frame(spark, docs), frame(spark, items, BENCH)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_matches(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) >= 40
    assert all(r.score >= decontam.THRESHOLD - 1e-9 for r in got)
    clean = decontam.clean(frame(spark, docs), frame(spark, items, BENCH))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {r.doc_id for r in got}


def test_search_equals_full_scoring():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(3, 30))).encode()) for i in range(300)]
    df = {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    index = decontam.Index(items, df, len(items), sum(len(t.split()) for _, t in items) / len(items))
    for k in range(200):
        terms = sorted({index.term[w] for w in items[rng.randrange(300)][1].split()[: rng.randint(1, 30)]})
        full = {}
        for t in terms:
            for item, x in zip(index.items[t], index.weights[t]):
                full[item] = full.get(item, 0) + x
        for threshold in (0.2, 0.6, 0.9):
            assert dict(index.search(terms, threshold)).keys() == {i for i, s in full.items() if s >= threshold - 1e-9}


def test_blocks_of_items_give_the_same(spark):
    docs, items = planted(random.Random(6))
    whole = decontam.contaminated(frame(spark, docs), frame(spark, items, BENCH)).drop("passage").collect()
    parts = decontam.contaminated(frame(spark, docs), frame(spark, items, BENCH), items=15).drop("passage").collect()
    short = lambda rows: sorted((r.doc_id, r.item_id, round(r.score, 9), r.overlap) for r in rows)
    assert short(whole) == short(parts)


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = frame(spark, [(1, "the same text of these copies is here for every one of them to find"), (1, None), (None, "x"), (2, "")], BENCH)
    got = decontam.contaminated(docs, items)
    assert sorted(r.doc_id for r in got.collect()) == [-5, 1, 2, 2]
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontam.contaminated(docs, items.limit(0)).count() == 0 and decontam.clean(docs, items.limit(0)).count() == docs.count()
    assert decontam.contaminated(docs.limit(0), items).count() == 0
