"""Lempel-Ziv phrase fingerprints.

A text's bytes are parsed into dictionary phrases as LZ78 does: each phrase is
the longest earlier phrase and one byte more, and becomes part of the
dictionary; an unfinished phrase at the end adds none. Texts that compress well
together share phrases. The phrase set is hashed, and its SIZE smallest hashes
are the signature; the likeness of two signatures estimates the Jaccard
similarity of the phrase sets, as the share of common hashes among the SIZE
smallest of both together (exact for sets of up to SIZE phrases). All phrases
count, at every size of a text.

edited_likeness() compares each text with its edited form and with the next
document. Documents are dealt out by ranges of doc_id and sorted, once; the
first of the next lower range comes along, so that a range's last document
finds its successor without a second shuffle.

Null texts count as empty; two empty texts have likeness 1, an empty one and
another 0. Order is by descending doc_id, ties by the text's hash, then by the
text; null doc_ids come last. A document alone is its own successor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions, prepare

SIZE = 128
SHORT = 1  # bytes of the shortest phrase that counts: all do
SEED = 11
FACTOR, MASK = 0x278DDE6D, 2**30 - 1  # of the rolling hash, whose products stay small numbers
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 by the golden ratio


class Parse:
    """An LZ78 parse that can go on, and back to where it was."""

    def __init__(self):
        self.next: dict[int, int] = {}  # (phrase << 8 | byte) -> phrase
        self.at = 0  # the phrase being matched; 0: none
        self.hashes = [SEED]  # of each phrase, 0 first
        self.sizes = [0]

    def feed(self, data: bytes) -> Parse:
        get, put, hashes, sizes, at = self.next.get, self.next, self.hashes, self.sizes, self.at
        for c in data:
            key = at << 8 | c
            to = get(key)
            if to is None:
                put[key] = len(hashes)
                hashes.append((hashes[at] * FACTOR + c + 1) & MASK)
                sizes.append(sizes[at] + 1)
                at = 0
            else:
                at = to
        self.at = at
        return self

    def place(self) -> tuple[int, int]:
        return len(self.hashes), self.at

    def back(self, place: tuple[int, int]) -> Parse:
        """To an earlier place(): the last phrases go."""
        n, self.at = place
        for _ in range(len(self.hashes) - n):
            self.next.popitem()
        del self.hashes[n:], self.sizes[n:]
        return self

    def signature(self) -> np.ndarray:
        """The SIZE smallest hashes of the phrases, mixed to 32 bits, ascending."""
        hashes = np.array(self.hashes, np.uint64)[1:]
        if not len(hashes):
            return hashes.astype(np.uint32)
        hashes = ((hashes + np.uint64(1)) * MIX >> np.uint64(32)).astype(np.uint32)
        if len(hashes) > 4 * SIZE:  # phrases are distinct, their hashes all but
            hashes = np.partition(hashes, 2 * SIZE)[: 2 * SIZE]
        return np.unique(hashes)[:SIZE]


def text_of(signature: np.ndarray) -> str:
    """8 hex digits a hash; empty for a text without phrases."""
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    distinct = len(both) - int(twice.sum())
    if distinct > SIZE:
        nth = np.arange(2, len(both) + 1) - np.cumsum(twice)  # distinct hashes up to the second of a pair
        return float((twice & (nth <= SIZE)).sum() / SIZE)
    return float((len(both) - distinct) / distinct)


def signature(text: bytes) -> np.ndarray:
    return Parse().feed(text).signature()


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fingerprint string; one row for each row of docs."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(signature(bytes(t))) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(mapped, f"doc_id {kind}, fingerprint string")


def _row(text: str, own: np.ndarray, parsed: Parse, after: str, next_own: np.ndarray):
    """The digests of one document; parsed: of all but the last third."""
    third = len(text) // 3
    tail = after[:third]
    edited = text[: len(text) - third] + tail
    theirs = own if not third else parsed.feed(tail.encode()).signature()
    return (len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(theirs), likeness(own, theirs), likeness(own, next_own))


def _parsed(text: str) -> tuple[np.ndarray, Parse]:
    """A text's signature, and its parse up to the last third."""
    third = len(text) // 3
    parse = Parse().feed(text[: len(text) - third].encode())
    if not third:
        return parse.signature(), parse
    place = parse.place()
    own = parse.feed(text[len(text) - third :].encode()).signature()
    return own, parse.back(place)


def edited_likeness(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next:
    each text beside its edited form (the last third replaced by as much of the next document's beginning) and
    beside the next document, by descending doc_id, the first after the last. One row for each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = ranges or partitions(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    splits = rows.select(F.percentile_approx("place", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    splits = sorted(set(splits or []))
    # The range is the number of splits below the place: a search in a list as long as the partitions are many.
    bounds = F.array(*(F.lit(s).cast("bigint") for s in splits)) if splits else None
    at = F.size(F.filter(bounds, lambda s: s < F.col("place"))) if splits else F.lit(0)
    ranged = rows.withColumn("range", at)
    tops = {r.range: r.top for r in ranged.groupBy("range").agg(F.max("place").alias("top")).collect()}  # one of each range
    order = sorted(tops)
    # A range's largest document also goes to the next higher range, the largest of all to the lowest.
    to = {tops[r]: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    extra = F.create_map(*(F.lit(x).cast(t) for p in to.items() for x, t in zip(p, ("bigint", "int"))))[F.col("place")] if to else F.lit(None).cast("int")
    targets = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("extra")), F.struct(extra.alias("range"), F.lit(1).alias("extra")))
    dealt = (ranged.withColumn("target", F.explode(targets)).where("target.range is not null")
             .select(F.col("target.range").alias("range"), F.col("target.extra").alias("extra"), "place", "doc_id", "text")
             .repartition(max(1, ranges), "range")
             .sortWithinPartitions(F.asc("range"), F.asc("extra"), F.desc("place"), F.xxhash64("text"), "text"))

    def mapped(batches):
        waiting = None  # (range, doc_id, text, signature, parse) of the last document
        done = []
        for batch in batches:
            for where, extra, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3))):
                if extra and (waiting is None or waiting[0] != where):
                    continue  # further rows of the same largest doc_id
                own, parsed = _parsed(text)
                if waiting is not None and waiting[0] == where:
                    done.append((waiting[1], *_row(*waiting[2:], text, own)))
                waiting = None if extra else (where, doc_id, text, own, parsed)
                if len(done) >= 1000:
                    yield _batch(done)
                    done = []
        yield _batch(done)

    def _batch(done):
        c = list(zip(*done)) or [()] * 7
        types = [to_arrow_type(docs_type), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=names)

    docs_type = docs.schema["doc_id"].dataType
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.select("range", "extra", "doc_id", "text").mapInArrow(
        mapped, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
