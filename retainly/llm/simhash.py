"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has one bit per position of its shingles' 64-bit hashes,
set where over half of them have it. Two fingerprints that differ in d bits at
most, cut into m parts with thresholds t_1 .. t_m that add up to d - m + 1,
differ in t_i bits at most in some part i; a part with threshold -1 need not
be looked at. So candidates are sought part by part: a fingerprint is filed
under each value that its part takes when up to t_i of its set bits are
cleared, and two parts that differ in t_i bits at most meet under their common
bits. Whatever meets is verified on all 64 bits.

Correlated bits go into one part, and the number of parts and their thresholds
come from dynamic programming on estimated costs: filed rows, and candidate
pairs by the spread of distances among a bounded sample of fingerprints. The
sample steers the cost only; every plan finds every link.

Equal fingerprints are one node, so copies never meet. A value that very many
fingerprints share is cut into blocks that meet pairwise in tasks of bounded
size, and a group gives the links that connect it rather than all its pairs.
Null texts count as empty: fingerprint zero.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, partitions, prepare, saved
from .graph import components

BITS = 64
SEED = 42
SAMPLE = 2048  # fingerprints that the cost estimates use
BLOCK = 8192  # rows of one value that are compared in one piece
SMALL = 64  # rows of a group whose pairs are compared by shifts
PAIR_COST = 0.03  # of comparing a pair, in filed rows


def fingerprint(text: bytes, words: int = 4) -> int:
    """Unsigned fingerprint of a text's word shingles; zero without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, key1, key2 (the row's key), fp long."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(batches):
        for b in batches:
            found = np.array([fingerprint(bytes(t), words) for t in b.column(3).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found)], names=["doc_id", "key1", "key2", "fp"])

    return docs.select("doc_id", *row_key(), body().alias("body")).mapInArrow(mapped, f"doc_id {kind}, key1 bigint, key2 int, fp bigint")


def row_key():
    """96 bits that tell (doc_id, text) apart, nulls included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(F.isnull("doc_id"), "doc_id", text).alias("key1"), F.hash(text, "doc_id", F.isnull("doc_id")).alias("key2")


# --- The plan -------------------------------------------------------------------------------------------------


def parts_of(sample: np.ndarray, m: int) -> list[int]:
    """Masks of m parts of near equal width, grown from the most correlated bits."""
    if len(sample) > 1:
        bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        bits -= bits.mean(0)
        spread = np.sqrt((bits**2).sum(0))
        like = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-9)
    else:
        like = np.zeros((BITS, BITS))
    np.fill_diagonal(like, 0)
    free, masks = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        among = like[np.ix_(free, free)]
        own = [free.pop(int(among.max(1).argmax()))]
        while len(own) < width:
            own.append(free.pop(int(like[np.ix_(free, own)].mean(1).argmax())))
        masks.append(sum(1 << b for b in own))
    return masks


def plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the parts that are looked at, for n fingerprints: the cheapest by estimate."""
    best = None
    drawn = sample[:, None] ^ sample[None, :]
    drawn = drawn[np.triu_indices(len(sample), 1)]
    for m in range(max(1, (distance + 1) // 3), distance + 2):
        masks = parts_of(sample, m)
        costs = []
        for mask in masks:
            width = mask.bit_count()
            apart = np.bitwise_count(drawn & np.uint64(mask))
            cost = {-1: 0.0}
            for t in range(0, min(distance, 2) + 1):
                near = min(2 * t, width)  # two values meet when each has cleared t bits
                share = max(float((apart <= near).mean()) if len(drawn) else 0.0, sum(comb(width, j) for j in range(near + 1)) / 2**width)
                filed = sum(comb(max(width // 2, 1), j) for j in range(t + 1))
                cost[t] = n * filed + PAIR_COST * share * n * n / 2
            costs.append(cost)
        # least[s]: cheapest thresholds of the parts so far that add up to s
        least: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for cost in costs:
            after: dict[int, tuple[float, tuple]] = {}
            for s, (c, chosen) in least.items():
                for t, extra in cost.items():
                    if s + t not in after or c + extra < after[s + t][0]:
                        after[s + t] = (c + extra, (*chosen, t))
            least = after
        found = least.get(distance - m + 1)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], [(mask, t) for mask, t in zip(masks, found[1]) if t >= 0])
    return best[1]


# --- Probing and verification ---------------------------------------------------------------------------------


def _filed(fps: np.ndarray, mask: int, threshold: int):
    """(values, fingerprints): each under its part's value with up to `threshold` set bits cleared."""
    own = fps & np.uint64(mask)
    yield own, fps
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    for k in range(1, threshold + 1):
        for chosen in combinations(bits, k):
            clear = np.uint64(sum(chosen))
            has = (own & clear) == clear
            if has.any():
                yield own[has] & ~clear, fps[has]


def spanning(fps: np.ndarray, distance: int):
    """Links that connect what lies within the distance, from each fingerprint to those that no other has reached."""
    left, made = np.unique(fps), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            near = np.bitwise_count(left ^ p) <= distance
            if near.any():
                reached = left[near]
                made.append(np.stack([np.full(len(reached), p), reached]))
                front.extend(reached)
                left = left[~near]
    return made


def _linked(groups: np.ndarray, fps: np.ndarray, distance: int):
    """Links within groups; rows of a group are adjacent."""
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[edge, len(groups)])
    made = []
    for k in np.flatnonzero(sizes > SMALL):
        made += spanning(fps[edge[k] : edge[k] + sizes[k]], distance)
    few = np.repeat(sizes <= SMALL, sizes)
    groups, fps = groups[few], fps[few]
    for shift in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        same = groups[shift:] == groups[:-shift]
        a, b = fps[:-shift][same], fps[shift:][same]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        if near.any():
            made.append(np.stack([a[near], b[near]]))
    return made


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fps (fp long), distinct -> a long, b long: links that connect all fingerprints within the distance
    (each is a true link; a link between two is left out only where others connect them)."""
    spark = fps.sparkSession
    prepare(spark)
    n = fps.count()
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    chosen = plan(sample, n, distance)

    def filed(batches):
        for batch in batches:
            found = np.asarray(batch.column(0)).view(np.uint64)
            for part, (mask, threshold) in enumerate(chosen):
                for values, own in _filed(found, mask, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(values.view(np.int64)), pa.array(own.view(np.int64))], names=["part", "value", "fp"])

    rows = fps.select("fp").mapInArrow(filed, "part int, value bigint, fp bigint")
    # Values with over BLOCK rows are cut into blocks, and each pair of blocks is compared by itself.
    # There are at most rows / BLOCK of them, so their list is small beside the data.
    hot = saved(rows.groupBy("part", "value").count().where(F.col("count") > BLOCK)
                .select("part", "value", F.ceil(F.col("count") * 2 / BLOCK).cast("int").alias("blocks")), "hot-values")
    if hot.isEmpty():
        rows = rows.withColumn("pair", F.lit(0))
    else:
        rows = rows.join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        rows = (rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("pair", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")))
    dealt = (rows.select(F.xxhash64("part", "value", "pair").alias("group"), "fp")
             .repartition(partitions(spark), "group").sortWithinPartitions("group"))

    def compared(batches):
        kept_g, kept_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            g = np.concatenate([kept_g, np.asarray(batch.column(0))])
            f = np.concatenate([kept_f, np.asarray(batch.column(1)).view(np.uint64)])
            done = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            kept_g, kept_f = g[done:], f[done:]
            yield from _batches(_linked(g[:done], f[:done], distance)) if done else ()
        if len(kept_g):
            yield from _batches(_linked(kept_g, kept_f, distance))

    return dealt.mapInArrow(compared, "a bigint, b bigint")


def _batches(made):
    for ab in made:
        yield pa.RecordBatch.from_arrays([pa.array(ab[0].view(np.int64)), pa.array(ab[1].view(np.int64))], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, key1, key2, fingerprint (16 hex digits), root (of its component), component_id
    (the smallest doc_id that it reaches over links; null where all are). One row for each row of docs."""
    marked = saved(fingerprints(docs, words), "fingerprints")
    nodes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes, distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias("node"), "root", "component_id")
    named = saved(named, "fingerprint-components")
    found = marked.join(named, marked["fp"] == named["node"])
    return found.select("doc_id", "key1", "key2", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def representatives(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """One row of docs for each component, with its columns; of rows that agree in doc_id and text one stays."""
    names = {k: f"{k}_of_row" for k in ("key1", "key2")}
    while set(names.values()) & set(docs.columns):
        names = {k: v + "_" for k, v in names.items()}
    a, b = names.values()
    # The row that stands for a component: of its smallest doc_id's rows the one with the smallest key.
    first = (near_duplicates(docs, words, distance).where("doc_id <=> component_id")
             .groupBy("root").agg(F.min("key1").alias(a), F.min_by("key2", "key1").alias(b)).select(a, b))
    own = docs.withColumns({v: c for v, c in zip((a, b), row_key())})
    nth = Window.partitionBy(a, b).orderBy(a)
    place = names["key1"] + "_place"
    return own.join(first, [a, b]).withColumn(place, F.row_number().over(nth)).where(F.col(place) == 1).select(*docs.columns)
