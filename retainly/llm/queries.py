"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cdc, decontam, fixity, hmm, lempel, manifest, periodic, quantized, ranking, reshard, simhash, suffixes
from .common import prepare, saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return put


def tokenizer() -> tuple[dict[bytes, int], str]:
    """The public vocabulary's ranks and split pattern."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query("op1_bpe_round_trip")
def op1(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), *tokenizer())


OLD_SHARDS, NEW_SHARDS = 16, 24


@query("op2_reshard_rows")
def op2(spark, sf_dir):
    """From 16 shards by source to 24 of as many rows each."""
    rows = reshard.sized(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(OLD_SHARDS)))
    return reshard.assign(rows, NEW_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


FILE_PAGES = 256

OP3_SQL = f"""
WITH r AS (
  SELECT page_id, page_id // {FILE_PAGES} AS file,
    strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
      || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)) + strlen(coalesce(html, '')) + 4 AS length
  FROM pages),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM r)
SELECT CAST(file AS BIGINT) AS file, CAST(place AS BIGINT) AS "offset", CAST(page_id AS BIGINT) AS page_id, CAST(length AS BIGINT) AS length,
  CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM o WHERE page_id % 211 = 7 OR page_id % 97 = 5
"""


@query("op3_merkle_audit", OP3_SQL)
def op3(spark, sf_dir):
    """Pages as WARC files of 256 records, against a replica with damage by rule."""
    pages = table(spark, sf_dir, "pages")
    file = F.floor(F.col("page_id") / FILE_PAGES)
    ours = saved(fixity.records(pages, file), "warc-records")
    return fixity.audit(ours, fixity.damaged(ours, pages, file))


@query("op4_hidden_markov")
def op4(spark, sf_dir):
    return hmm.scores(table(spark, sf_dir, "documents"))


@query("op5_decontaminate")
def op5(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op6_quality_ranking")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ranking.classify(docs, ranking.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_chunk_dedup")
def op7(spark, sf_dir):
    return cdc.spans(table(spark, sf_dir, "documents"))


@query("op8_simhash_groups")
def op8(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    return suffixes.kept(table(spark, sf_dir, "documents"))


@query("op10_lempel_ziv")
def op10(spark, sf_dir):
    return lempel.edited_likeness(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_bool_or(list_transform(x, lambda c: c <> 0)) THEN x END AS x
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query("op11_product_quantisation", OP11_SQL)
def op11(spark, sf_dir):
    return quantized.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    """With the tails of some documents made to repeat, by the checksum of their ids."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.digests(periodic.runs(table(spark, sf_dir, "documents"), checksum))


def _op13_sql(levels: int, above: int) -> str:
    """Trees of up to 8^levels rows a language and 8^above languages, level by level."""
    fields = lambda text: " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
    # crc32 bit by bit: the polynomial 0xEDB88320 in decimal.
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [f"""d AS MATERIALIZED (SELECT doc_id, lang AS grp, sha256({fields('text')}) AS leaf,
      CASE WHEN {crc} % 3 = 0 THEN sha256({fields(lower)}) END AS tampered FROM documents)""",
             """t0 AS MATERIALIZED (SELECT doc_id, grp, leaf AS hash, coalesce(tampered, leaf) AS folded, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
      count(*) OVER (PARTITION BY grp) AS n FROM d)"""]

    def tree(t, depth):
        for k in range(depth):
            parts.append(f"""{t}{k + 1} AS MATERIALIZED (SELECT grp, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(hash, '' ORDER BY pos)) AS hash FROM {t}{k} WHERE n > 1 GROUP BY 1, 2, 3)""")
            side = lambda rows: f"coalesce(string_agg(hash, '') OVER (PARTITION BY grp, pos // 8 ORDER BY pos ROWS BETWEEN {rows}), '')"
            parts.append(f"""{t}s{k} AS MATERIALIZED (SELECT grp, pos, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {t}{k} WHERE n > 1)""")
        parts.append(f"{t}r AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT grp, hash FROM {t}{k} WHERE n = 1" for k in range(depth + 1)) + ")")

    tree("t", levels)
    parts.append("g0 AS MATERIALIZED (SELECT 0 AS grp, grp AS lang, hash, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tr)")
    tree("g", above)
    steps = [(f"ts{k}", "s.grp IS NOT DISTINCT FROM f.grp", "f.pos", k) for k in range(levels)] + [(f"gs{k}", "true", "f.up", k) for k in range(above)]
    parts.append("""f0 AS MATERIALIZED (SELECT t0.doc_id, t0.grp, t0.hash AS leaf, t0.pos, g0.pos AS up, g0.hash AS subroot, gr.hash AS root, t0.folded AS h, '' AS proof
      FROM t0 JOIN g0 ON g0.lang IS NOT DISTINCT FROM t0.grp, gr)""")
    for j, (table_, same, at, k) in enumerate(steps):
        parts.append(f"""f{j + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (h, proof), CASE WHEN s.pos IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h, f.proof || coalesce(s.l || s.r, '') AS proof
      FROM f{j} f LEFT JOIN {table_} s ON {same} AND s.pos = {at} // {8**k})""")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM f{len(steps)}"


OP13_SQL = _op13_sql(levels=6, above=2)


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark, sf_dir):
    """One tree a language; where 3 divides the checksum of the id, the text is held against its proof in lower case."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in manifest.FIELDS]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (lowered != F.col("text")), manifest.leaf([*fields[:-1], lowered]))
    leaves = docs.select(F.col("lang").alias("grp"), "doc_id", manifest.leaf(fields).alias("hash"), tampered.alias("tampered"))
    found = manifest.proofs(leaves, ["doc_id"], ["doc_id", "tampered"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = manifest.fold(F.coalesce("tampered", "hash"), F.col("path"))
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
