"""Substring dedup by content-defined chunking.

A gear hash rolls over the text's bytes: each byte shifts it left and adds the
byte's entry of a fixed table, so it depends on the last WINDOW bytes alone. A
text is cut after white space where the hash is under a bound, on average
after every WORDS_A_CHUNK words, and where the WINDOW bytes have no white space
(Chinese, Japanese or Thai text, long URLs, base64) also between other
characters, some BYTES_A_CHUNK bytes apart. Cuts thus follow from the WINDOW
bytes before them, whatever else the text holds: an insertion changes the
chunks that it touches and no others, and a passage gives the same chunks in
every document, but for its ends. Only stretches of over LONG bytes in which
no cut falls all the same, as of one short word, are cut at more places.

Chunks are compared by digest over the whole corpus. A chunk is a duplicate if
the same document has it further up or a document with a smaller doc_id has it
(null before all others); runs of duplicates of min_bytes or more are removed,
shorter ones are left, as a common phrase is not a copied passage. The first
occurrence always stays.

Each document is counted once for a digest; digests are combined before the
shuffle, and the join that brings the smallest doc_id back has one row for a
digest on one side, so that Spark can split a digest that very many documents
have. Rows that agree in doc_id are parts of one document as regards other
documents; null texts count as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, prepare

WINDOW = 16
WORDS_A_CHUNK = 4
BYTES_A_CHUNK = 32
LONG = 1024
MIN_BYTES = 64
SEED = 7

#: The gear table: 16 bits of each byte's hash.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), SEED) & 0xFFFF for b in range(256)], np.uint16)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts(text: bytes) -> list[int]:
    """Ends of the text's chunks, ascending; the last is its length."""
    if not text:
        return []
    codes = np.frombuffer(text, np.uint8)
    gear = GEAR[codes]
    for width in (1, 2, 4, 8):  # to windows of 2, 4, 8 and 16 bytes
        gear[width:] += gear[:-width] << width
    space = SPACE[codes]
    cut = space & (gear < 65536 // WORDS_A_CHUNK)
    starts = np.r_[codes[1:] & 0xC0 != 0x80, True]  # the next byte begins a character
    at = np.r_[-1, np.flatnonzero(space), len(text)]
    for k in np.flatnonzero(np.diff(at) > WINDOW).tolist():
        own = slice(at[k] + WINDOW, at[k + 1])  # where the window has no white space
        # characters of several bytes are fewer than bytes, so that each is likelier to be an end
        bound = np.where(codes[own] < 0x80, 65536 // BYTES_A_CHUNK, 3 * 65536 // BYTES_A_CHUNK)
        cut[own] |= starts[own] & (gear[own] < bound)
    ends = np.unique(np.r_[np.flatnonzero(cut) + 1, len(text)])
    gaps = np.diff(np.r_[0, ends])
    if gaps.max() > LONG:
        more = np.flatnonzero((gear < 512) & starts) + 1
        long = np.searchsorted(ends, more, "left")
        ends = np.unique(np.r_[ends, more[gaps[np.minimum(long, len(gaps) - 1)] > LONG]])
    return ends.tolist()


def digests(text: bytes, ends: list[int]) -> np.ndarray:
    """128 bits a chunk, as rows of two signed numbers."""
    digest, start, made = xxhash.xxh3_128_digest, 0, []
    for end in ends:
        made.append(digest(text[start:end]))
        start = end
    return np.frombuffer(b"".join(made), ">i8").astype(np.int64).reshape(-1, 2)


def removed_spans(text: bytes, elsewhere: set, min_bytes: int = MIN_BYTES) -> tuple[list[tuple[int, int]], int]:
    """(start, end) of the runs of duplicates to remove, and the number of chunks. elsewhere: the digests that
    an earlier document has."""
    ends, seen, spans, start, run = cuts(text), set(), [], 0, None
    for end, key in zip(ends, map(tuple, digests(text, ends)[:, :2].tolist())):
        if key in seen or _short(key) in elsewhere:
            run = start if run is None else run
        else:
            if run is not None and start - run >= min_bytes:
                spans.append((run, start))
            run = None
        seen.add(key)
        start = end
    if run is not None and start - run >= min_bytes:
        spans.append((run, start))
    return spans, len(ends)


def _short(key):
    """The 96 bits of a digest that are shuffled."""
    return key[0], key[1] >> 32


def _order(col="doc_id"):
    """doc_id as a number that sorts nulls first."""
    return F.coalesce(F.col(col).cast("bigint"), F.lit(-(2**63)))


def chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc, d1, d2: every document's distinct chunk digests."""
    prepare(docs.sparkSession)

    def mapped(batches):
        for batch in batches:
            rows, sizes = [], []
            for text in batch.column(1).to_pylist():
                text = bytes(text)
                d = digests(text, cuts(text)) if text else np.empty((0, 2), np.int64)
                d = np.stack([d[:, 0], d[:, 1] >> 32], 1)
                if len(d) > 1:
                    d = np.unique(d, axis=0) if len(d) > 4096 else np.array(list(dict.fromkeys(map(tuple, d.tolist()))), np.int64)
                rows.append(d)
                sizes.append(len(d))
            if sum(sizes):
                all_rows = np.concatenate([r for r in rows if len(r)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), sizes)), pa.array(all_rows[:, 0]), pa.array(all_rows[:, 1].astype(np.int32))], names=["doc", "d1", "d2"])

    return docs.select(_order().alias("doc"), body().alias("body")).mapInArrow(mapped, "doc bigint, d1 bigint, d2 int")


def shared_chunks(docs: DataFrame) -> DataFrame:
    """doc -> found array<struct<d1, d2>>: the digests of a document that an earlier one has (documents with any)."""
    rows = chunks(docs)
    first = rows.groupBy("d1", "d2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("d1", "d2", "low")
    later = rows.join(first, ["d1", "d2"]).where("doc > low")
    return later.groupBy("doc").agg(F.collect_list(F.struct("d1", "d2")).alias("found"))  # a document's own chunks


def _with_found(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, str, str]:
    doc, found = "doc_of_row", "found_of_row"
    while {doc, found} & set(taken):
        doc, found = doc + "_", found + "_"
    shared = shared_chunks(docs).toDF(doc, found)
    return docs.withColumn(doc, _order()).join(shared, doc, "left"), doc, found


def _elsewhere(found) -> set:
    return {(x["d1"], x["d2"]) for x in found or ()}


def spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, n_chunks (long), kept_sha256, spans
    array<struct<start, end>> (bytes): what is removed from each document. One row for each row of docs."""
    prepare(docs.sparkSession)
    joined, _, found = _with_found(docs.select("doc_id", "text"), ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def mapped(batches):
        for batch in batches:
            made = []
            for text, elsewhere in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = bytes(text)
                cut, n = removed_spans(text, _elsewhere(elsewhere), min_bytes)
                kept = without(text, cut)
                made.append((len(text), len(text) - len(kept), len(cut), n, hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in cut]))
            if made:
                c = list(zip(*made))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[k], pa.int64()) for k in range(4)), pa.array(c[4], pa.string()), pa.array(c[5], out)],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_chunks", "kept_sha256", "spans"])

    return joined.select("doc_id", body().alias("body"), found).mapInArrow(
        mapped, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, n_chunks bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def without(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in cut:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def deduplicated(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with their columns, removed passages cut out of text; every row stays, and a null text stays null.
    An n_chars column counts the new text's characters."""
    prepare(docs.sparkSession)
    joined, doc, found = _with_found(docs, docs.columns)

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, elsewhere: pd.Series) -> pd.Series:
        return texts.combine(elsewhere, lambda t, e: without(t := bytes(t), removed_spans(t, _elsewhere(list(e) if e is not None else ()), min_bytes)[0]).decode("utf-8", "replace"))

    kept = F.when(F.col("text").isNotNull(), cut_out(body(), F.col(found)))
    out = joined.withColumn("text", kept)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
