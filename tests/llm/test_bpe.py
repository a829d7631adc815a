import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retainly.llm import bpe

from .helpers import SMALL, awkward

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_as_the_library(both, text):
    ours, theirs = both
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text)) == text.encode()


def test_mixed_signs_as_the_library(both):
    ours, theirs = both
    rng = random.Random(1)
    signs = " \n\t\r\x1c\x85\xa0  a'sé日ñ12٣²_!.-=#𝕏​́힣abcdefgh THE"
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert ours.encode(text) == theirs.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 30_000, "=-" * 20_000, "日本" * 9000, "\n" * 1000 + "x", "ab" * 30_000])
def test_long_runs_as_the_library(both, text):
    ours, theirs = both
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_memo_that_overflows_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    encoder = bpe.Encoder(both[0].ranks, P.PATTERN)
    text = "one two three four five one two three four five one"
    assert encoder.encode(text) == both[1].encode_ordinary(text) and len(encoder.memo) <= 3


def test_without_runs_the_pattern_alone_decides(both):
    encoder = bpe.Encoder(both[0].ranks, r"\s+|\S+", by_runs=False)
    assert encoder.decode(encoder.encode("a  b\n\nc")) == b"a  b\n\nc"


def test_whole_table(spark, both):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.encode_digests(docs, both[0].ranks, P.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = both[1].encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark, both):
    docs = awkward(spark)
    got = bpe.encode(docs, both[0].ranks, P.PATTERN).collect()
    assert sorted((repr(r.doc_id), r.decoded) for r in got) == sorted((repr(r.doc_id), r.text or "") for r in docs.collect())
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode(docs.limit(0), both[0].ranks, P.PATTERN).count() == 0
