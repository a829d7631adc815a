import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from retainly.llm import manifest
from retainly.llm.queries import QUERIES, op13

from .helpers import SCHEMA, SMALL, frame


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """The root, and for each leaf its siblings by level as (left, right)."""
    paths, own, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            a = own[k] // 8 * 8
            path.append(("".join(level[a : own[k]]), "".join(level[own[k] + 1 : a + 8])))
            own[k] //= 8
        level = [H(*level[a : a + 8]) for a in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    """rows (doc_id, text, lang, source, n_chars) -> the query's rows."""
    made = [((d, s, la, n, t), (d, s, la, n, t if t is None or d is None or zlib.crc32(str(d).encode()) % 3 else
             "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for d, t, la, s, n in rows]
    langs = sorted({r[0][2] for r in made}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in made if r[0][2] == la), key=lambda r: (r[0][0] is not None, r[0][0] or 0, leaf(r[0]))) for la in langs]
    trees = [tree([leaf(r[0]) for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (subroot, paths), up in zip(groups, trees, above):
        for (old, new), path in zip(g, paths):
            folded = leaf(new)
            for left, right in path + up:
                folded = H(left, folded, right)
            out.append((old[0], leaf(old), subroot, root, H(*(s for side in path + up for s in side)), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows, tmp_path):
    frame(spark, rows, SCHEMA).withColumns({"hash": F.lit("x"), "grp": F.lit(1), "at": F.lit(2), "n": F.lit(3)}).write.parquet(str(tmp_path / "documents.parquet"))
    found = op13(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def some(n, langs, rng):
    return [(k, f"Text {k} É{rng.random()}" if k % 5 else None, rng.choice(langs), "s" if k % 3 else None, k * 3) for k in range(n)]


@pytest.mark.parametrize("n,langs", [(0, ["a"]), (1, [None]), (65, ["x", None]), (300, ["é", "z", None, "a", "", "Z"]), (60, [f"l{k}" for k in range(40)])])
def test_equals_a_plain_tree(spark, tmp_path, n, langs):
    rows = some(n, langs, random.Random(n))
    random.Random(1).shuffle(rows)
    assert got(spark, rows, tmp_path) == plain(rows)


def test_awkward_rows(spark, tmp_path):
    long = "Very Long " * 200_000
    rows = [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (1, "B", "en", "s", 1), (None, None, None, None, None), (None, "Q", "en", None, None), (2, "", "", "", 0),
            (3, long, "en", "s", 9), (-4, "一二", "zh", "s", 2)] + [(7, "copy", "en", "s", 4)] * 30
    assert got(spark, rows, tmp_path) == plain(rows)


def test_all_small_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, SMALL).collect()), key=repr) == plain(rows)


def test_hot_groups_and_ids_spread(spark):
    """One language, one id and equal rows: places come in even parts, each place once."""
    rows = spark.range(20_000).select(F.lit("en").alias("grp"), F.lit(5).alias("doc_id"), F.sha2((F.col("id") % 3 * F.col("id")).cast("string").cast("binary"), 256).alias("hash"))
    placed = manifest.placed(rows, ["doc_id", "hash"])
    assert sorted(r.at for r in placed.select("at").collect()) == list(range(20_000)) and {r.n for r in placed.select("n").distinct().collect()} == {20_000}
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 5 * 20_000 / 8


def test_a_changed_leaf_is_found(spark):
    rows = frame(spark, [("g", k, H(str(k))) for k in range(100)], "grp string, k bigint, hash string")
    found = manifest.proofs(rows, ["k"], ["k"])
    assert found.where(manifest.fold(F.col("hash"), F.col("path")) != F.col("root")).count() == 0
    assert found.where(manifest.fold(F.sha2(F.col("hash").cast("binary"), 256), F.col("path")) == F.col("root")).count() == 0
