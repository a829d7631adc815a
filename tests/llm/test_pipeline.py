import zlib

import pytest

import corpus_pipeline
from retainly.llm import bpe, cdc, decontam, ranking, simhash

from .helpers import SMALL, awkward, frame
from .test_cdc import brute as brute_chunks
from .test_decontam import brute_matches
from .test_simhash import brute_groups

P = pytest.importorskip("public_tokenizers")


def test_stages_and_their_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, word in zip(names, ("quality", "SimHash", "substring", "benchmark", "BPE")):
        assert word in name


def test_run_equals_brute_force_stage_by_stage(spark):
    """Each stage's result by its definition, on what the stage before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    model = ranking.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = {r.doc_id for r in ranking.classify(docs, model).collect() if r.score >= 0.3}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    first = {c for _, _, c in brute_groups(rows)}
    rows = [r for r in rows if r[0] in first]
    rows = brute_chunks(rows)
    found = {d for d, _ in brute_matches(rows, items)}
    rows = [r for r in rows if r[0] not in found]
    encoder = bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    want = sorted((d, len(ids := encoder.encode(t)), zlib.crc32(encoder.decode(ids))) for d, t in rows)
    got = corpus_pipeline.run(spark, SMALL)
    texts = dict(rows)
    assert sorted((r.doc_id, r.n_tokens, zlib.crc32(texts[r.doc_id].encode())) for r in got.collect()) == want
    assert len(want) > 100


def test_stages_keep_the_columns_and_take_awkward_rows(spark, tmp_path):
    frame(spark, [(1, 1, 0), (2, 0, 0), (6, 1, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [(1, "a test item that nothing holds at all, not even in part")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (awkward(spark), awkward(spark).limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns and out.count() <= docs.count()
            else:
                assert out.count() == docs.count()


def test_decisions_take_effect(spark):
    rows = [(1, "the first of two equal texts"), (2, "the first of two equal texts"), (3, "another one of its own")]
    assert sorted(r.doc_id for r in simhash.representatives(frame(spark, rows)).collect()) == [1, 3]
    passage = " ".join(f"word{i}" for i in range(60))
    cut = {r.doc_id: r.text for r in cdc.deduplicated(frame(spark, [(1, passage), (2, "before " + passage + " after")])).collect()}
    assert cut[1] == passage and len(cut[2]) < 150
    bench = frame(spark, [(1, passage)], "item_id bigint, text string")
    assert decontam.clean(frame(spark, [(1, passage), (2, "clean")]), bench).count() == 1
