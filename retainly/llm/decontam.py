"""Benchmark decontamination by a BM25 inverted index with block-max WAND.

The test items are indexed; every passage of every training document is a
query. A passage is WORDS words long and starts every STRIDE words, so that a
run of WORDS - STRIDE words lies whole in some passage. Contributions are
divided by the score that the item gives itself, so scores run from 0 to 1 and
one threshold fits short and long items; all items at the threshold or above
are retrieved. A passage whose terms' upper bounds don't reach the threshold
together is passed over after a sum over its words; the others go through
posting lists in item order, where a pivot is found by list bounds (WAND) and
is moved on to the next block of items that the terms' block bounds reach.

A retrieved item is verified against the whole document: the item's text up to
its first line break (without one: its first half) is the question, the rest
the answer, and of the item's runs of GRAM words the document has to have
SIMILAR or more, and of the question's and the answer's own PART or more.

Items are read in blocks of at most ITEMS; each block's index is broadcast, so
its size is bounded whatever the benchmark's, and each block is a pass over
the documents. Words are runs without ASCII white space, A-Z in lower case.
Items without words, and null texts, match nothing; repeated items match
separately if their ids differ.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import body, prepare

WORDS, STRIDE = 128, 64
THRESHOLD = 0.6
GRAM = 5
SIMILAR, PART = 0.8, 0.5
K1, B = 1.2, 0.75
BLOCK, BLOCKS = 16, 64  # items of a block at least, and blocks at most
ITEMS = 5_000  # items of one broadcast index


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def grams(words: list[bytes], size: int) -> set:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


class Index:
    """Items with impact-normalised postings. df, n, mean: of the whole benchmark; widest: words of its longest item."""

    def __init__(self, items: list[tuple[int, bytes]], df: dict[bytes, int], n: int, mean: float):
        self.ids = [i for i, _ in items]
        self.term: dict[bytes, int] = {}
        self.parts = []
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.widest = 0
        for at, (_, text) in enumerate(items):
            words = words_of(text)
            self.widest = max(self.widest, len(words))
            line = text.find(b"\n")
            cut = len(words_of(text[:line])) if line >= 0 else len(words) // 2
            cut = cut or len(words) // 2
            self.parts.append((grams(words, GRAM), grams(words[:cut], GRAM), grams(words[cut:], GRAM)))
            counts = Counter(words)
            norm = K1 * (1 - B + B * len(words) / mean) if mean else K1
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            total = sum(weight.values())
            for w, x in weight.items():
                postings[self.term.setdefault(w, len(self.term))].append((at, x / total))
        self.items = [[a for a, _ in postings[t]] for t in range(len(self.term))]
        self.weights = [[x for _, x in postings[t]] for t in range(len(self.term))]
        self.bound = [max(w) for w in self.weights]
        self.bounds = np.array(self.bound)
        # Blocks of `width` items, the same in all lists: the largest weight of each term in each block.
        self.width = max(BLOCK, -(-len(items) // BLOCKS))
        self.block_bounds = np.zeros((len(self.term), -(-len(items) // self.width)), np.float32)
        for t, (own, weights) in enumerate(zip(self.items, self.weights)):
            np.maximum.at(self.block_bounds[t], np.array(own) // self.width, weights)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that the distinct terms score at the threshold or above, by block-max WAND."""
        least = threshold - 1e-9
        reach = np.flatnonzero(self.block_bounds[terms].sum(0) >= threshold - 1e-4)  # sums in single precision
        if not len(reach):
            return []
        blocks, end, width = reach.tolist(), len(self.ids), self.width
        found, items, weights, bound_of = [], self.items, self.weights, self.bound
        lists = [[items[t][0], t, 0] for t in terms]  # current item, term, place
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += bound_of[x[1]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            ahead = bisect_left(blocks, item // width)
            if ahead == len(blocks):
                break
            if blocks[ahead] * width > item:  # no item before the next block in reach
                target, moved = blocks[ahead] * width, len(lists)
            else:
                while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                    pivot += 1
                target, moved = item, pivot + 1
                if lists[0][0] == item:
                    score = sum(weights[x[1]][x[2]] for x in lists[:moved])
                    if score >= least:
                        found.append((item, score))
                    target = item + 1
            for x in lists[:moved]:
                if x[0] < target:
                    own = items[x[1]]
                    x[2] = bisect_left(own, target, x[2])
                    x[0] = own[x[2]] if x[2] < len(own) else end
            lists = [x for x in lists if x[0] < end]
        return found

    def passages(self, terms: np.ndarray):
        """(start, distinct terms) of the passages whose upper bound reaches the threshold; terms: -1 for unknown words."""
        words, stride = max(WORDS, 2 * self.widest), max(STRIDE, self.widest)
        bound = np.where(terms >= 0, self.bounds[terms], 0.0) if len(self.bounds) else np.zeros(len(terms))
        total = np.r_[0.0, np.cumsum(bound)]
        starts = np.arange(0, max(1, len(terms) - words + stride), stride)
        ends = np.minimum(starts + words, len(terms))
        for k in np.flatnonzero(total[ends] - total[starts] >= THRESHOLD - 1e-9):
            own = set(terms[starts[k] : ends[k]].tolist())
            own.discard(-1)
            yield int(starts[k]), list(own)

    def matches(self, text: bytes) -> list[tuple]:
        """(item id, start word of the best passage, score, overlap, question's, answer's) of the verified items."""
        words = words_of(text)
        get = self.term.get
        terms = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple[float, int]] = {}
        for start, own in self.passages(terms):
            if own:
                for item, score in self.search(own, THRESHOLD):
                    if item not in best or score > best[item][0]:
                        best[item] = (score, start)
        if not best:
            return []
        have = {size: grams(words, size) for size in {len(next(iter(g))) for i in best for g in self.parts[i] if g}}
        made = []
        for item, (score, start) in sorted(best.items()):
            share = [sum(g in have[len(g)] for g in part) / len(part) if part else 1.0 for part in self.parts[item]]
            if share[0] >= SIMILAR and min(share[1:]) >= PART:
                made.append((self.ids[item], start, score, *share))
        return made


def indexes(benchmark: DataFrame, items: int = ITEMS):
    """Indexes of the benchmark (item_id, text, ...), by blocks of at most `items` items, one after the other."""
    bench = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text")).distinct()
    words = F.filter(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, total = bench.select(F.size(words).alias("k")).where("k > 0").agg(F.count(F.lit(1)), F.sum("k")).first()
    if not n:
        return
    blocks = math.ceil(bench.count() / items * 1.2) if bench.count() > items else 1
    for k in range(blocks):
        own = [(r.item_id, r.text.encode()) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toLocalIterator()]
        own = [x for x in own if words_of(x[1])]
        mine = sorted({w for _, t in own for w in words_of(t)})
        df: Counter = Counter()
        if blocks == 1:
            for _, t in own:
                df.update(set(words_of(t)))
        else:  # of this block's words, over all items
            held = bench.sparkSession.sparkContext.broadcast(set(mine))

            def counted(batches, held=held):
                for batch in batches:
                    c: Counter = Counter()
                    for t in batch.column(0).to_pylist():
                        c.update(held.value & set(words_of(bytes(t))))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["w", "c"])

            for r in bench.select(body()).mapInArrow(counted, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c")).collect():
                df[bytes(r.w)] = r.c
        if own:
            yield Index(own, df, n, total / n)


def contaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, key (of the text), item_id, passage (its first word's place), score,
    overlap, question_overlap, answer_overlap: a row for each document and item that it holds."""
    spark = docs.sparkSession
    prepare(spark)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, key bigint, item_id {item_kind.simpleString()}, passage bigint, score double, overlap double, question_overlap double, answer_overlap double"
    types = [to_arrow_type(item_kind), pa.int64(), *[pa.float64()] * 4]
    names = ["doc_id", "key", "item_id", "passage", "score", "overlap", "question_overlap", "answer_overlap"]
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), body().alias("body"))
    found = None
    for index in indexes(benchmark, items):
        shared = spark.sparkContext.broadcast(index)

        def mapped(batches, shared=shared):
            own = shared.value
            for batch in batches:
                at, made = [], []
                for k, text in enumerate(batch.column(2).to_pylist()):
                    for m in own.matches(bytes(text)):
                        at.append(k)
                        made.append(m)
                if made:
                    few = batch.take(pa.array(at))
                    columns = [pa.array(c, t) for c, t in zip(zip(*made), types)]
                    yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), *columns], names=names)

        part = rows.mapInArrow(mapped, schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """docs without those that hold a test item, with their columns."""
    spark = docs.sparkSession
    prepare(spark)
    kept = docs
    for index in indexes(benchmark, items):
        kept = kept.where(~_holds(spark.sparkContext.broadcast(index))(body()))
    return kept


def _holds(shared):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        own = shared.value
        return texts.map(lambda t: bool(own.matches(bytes(t)))).astype(bool)

    return holds
