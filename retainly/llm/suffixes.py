"""Exact removal of repeated substrings by a distributed, sparse suffix array.

A byte goes if it lies in a window (a string of WINDOW bytes of one document)
that also starts earlier: in a document with a smaller doc_id, or further up
in its own. Sorting a suffix for every byte would move each text a hundred
times over, so one suffix stands for a stretch of windows: a window belongs to
the anchor in it, the run of GRAM bytes with the smallest hash. Equal windows
have equal anchors at the same place, so only windows of one anchor string can
be equal, and an anchor's windows (some 30 on average) are sorted, moved and
compared together.

1. Texts are put into packs of some PACK bytes, kept in a table that is
   bucketed by pack, so that what is found later joins them without moving a
   text again.
2. Each pack lists its anchors: a hash of the anchor string and one of the
   whole stretch. Stretches that a pack has twice are settled there; the others
   meet by anchor hash, each of them once a pack however often it occurs. A
   stretch that an earlier document has is repeated as a whole. What is left to
   do are first stretches whose anchor also occurs in another stretch.
3. Those suffixes are range-partitioned by sampled splitters over their leading
   tokens (8 bytes each). A bucket sorts its suffixes by multikey quicksort, token by token
   within runs of equals, and compares the windows of each run of equal anchors.
4. An anchor string stays in one bucket unless it has more than LONG_RUN
   suffixes. The long ones are cut, and may fill several buckets, so they are
   compared across the cuts as well: the first of each window in a part is
   grouped by digest.

Stretches, and open windows across buckets, are equal if 128 bits of their
digests are: two that differ are taken as equal with a chance of 2^-128, also
among the stretches of one anchor string. Within buckets windows are compared
byte by byte.

Null texts are empty. Null doc_ids come before all others; rows of one doc_id
are not earlier than each other. Texts shorter than WINDOW stay as they are.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import body, partitions, prepare, saved, scratch_path

WINDOW = 100
GRAM = 32  # bytes of an anchor, a power of two
TOKEN = 8
PACK = 400_000  # bytes, unless a text is longer: a row that the JVM allocates like any other
BUCKET = 4_000_000  # bytes of packs that one task reads
LONG_RUN = 10_000  # suffixes of one anchor that a bucket compares by itself
ROWS = 100_000  # suffixes of a bucket

_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 3) for b in range(256)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 by the golden ratio
_SIGN = np.uint64(1 << 63)  # flipped in tokens, so that Spark's signed order is that of the bytes


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of GRAM bytes, by doubling."""
    h, power, width = _BYTES[codes], _ODD, 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            joined = h[:-width] * power
            joined += h[width:]
            h, power, width = joined, power * power, 2 * width
        h ^= h >> np.uint64(31)
        h *= _ODD
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, sizes: np.ndarray):
    """Of texts laid end to end: arrays (start, n, place, gram, stretch, doc). Windows start .. start+n-1 belong to
    the anchor at `place`; gram is the hash of the anchor, stretch (two columns) that of all bytes of its windows."""
    none = np.empty(0, np.int64)
    if len(text) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.reshape(0, 2), none
    hashes = gram_hashes(np.frombuffer(text, np.uint8))
    low = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    span, width = WINDOW - GRAM + 1, 1  # anchors that a window may have
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    inside = np.flatnonzero(np.arange(len(place)) + WINDOW <= ends[doc])  # windows within one text
    if not len(inside):
        return none, none, none, none.astype(np.uint64), none.reshape(0, 2), none
    place, doc = place[inside], doc[inside]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    n = np.diff(np.r_[new, len(place)])
    start = inside[new]
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(text[a:b]) for a, b in zip(start.tolist(), (start + n + WINDOW - 1).tolist())])
    stretch = np.frombuffer(found, ">i8").astype(np.int64).reshape(-1, 2)
    return start, n, place[new], hashes[place[new]], stretch, doc[new]


def settled(stretch, order, doc, start):
    """(by, known): the anchors in order of (stretch, order, doc, start), and which of those repeat one before."""
    by = np.lexsort((start, doc, order, stretch[:, 1], stretch[:, 0]))
    s, o, d = stretch[by], order[by], doc[by]
    same = np.r_[False, (s[1:] == s[:-1]).all(1)]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    known = same & ((o > o[first]) | np.r_[False, d[1:] == d[:-1]])
    return by, known


# --- Packs ----------------------------------------------------------------------------------------------------


def packs_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> a table bucketed by pack: pack long, ids, orders array<long>, sizes array<int>,
    text binary (the texts end to end)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    types = [pa.int64(), pa.list_(to_arrow_type(kind)), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

    def made(rows, number):
        ids, orders, texts = zip(*rows)
        whole = b"".join(texts)
        # by its place, as repeated rows may make equal packs; later steps read the names from the table
        name = TaskContext.get().partitionId() << 32 | number
        row = [name, list(ids), list(orders), [len(t) for t in texts], whole]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["pack", "ids", "orders", "sizes", "text"])

    def pack(batches):
        rows, n, number = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if rows and n + len(row[2]) > PACK:
                    yield made(rows, number)
                    rows, n, number = [], 0, number + 1
                rows.append((row[0], row[1], bytes(row[2])))
                n += len(row[2])
        if rows:
            yield made(rows, number)

    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    packed = docs.select("doc_id", order, body()).mapInArrow(pack, f"pack bigint, ids array<{kind.simpleString()}>, orders array<bigint>, sizes array<int>, text binary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions(spark, min(50_000, 1 + size // BUCKET))
    name = f"packs_{uuid.uuid4().hex}"
    packed.write.option("path", scratch_path(spark, "suffix-packs")).bucketBy(buckets, "pack").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and with them what the plan knows of the buckets
    return table


def _pack(batch, k: int, columns: int) -> list:
    return [batch.column(c)[k].as_py() for c in range(columns)]


# --- 2. Stretches ---------------------------------------------------------------------------------------------


def stretches(packs: DataFrame, ranges: int) -> DataFrame:
    """packs -> pack, repeated, open (array<int>: numbers of its anchors): stretches that an earlier document has,
    and first ones whose anchor string also has other stretches. Not among them: what a pack settles by itself."""

    def listed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pack, orders, sizes, text = _pack(batch, k, 4)
                sizes = np.array(sizes, np.int64)
                start, _, _, gram, stretch, doc = anchors(text, sizes)
                order = np.array(orders, np.int64)[doc]
                by, known = settled(stretch, order, doc, start)
                own = by[~known]
                # anchors have small hashes, being the smallest around; mixed again they spread over all parts
                part = ((gram[own] * _ODD >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                dealt = np.argsort(part, kind="stable")
                own, part = own[dealt], part[dealt]
                edges = np.searchsorted(part, np.arange(ranges + 1))
                used = np.flatnonzero(np.diff(edges))
                if len(used):
                    lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.r_[edges[used], len(own)].astype(np.int32)), pa.array(x[own], t))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(used.astype(np.int32)), pa.array(np.full(len(used), pack, np.int64)), lists(gram.view(np.int64), pa.int64()), *(lists(s, pa.int64()) for s in stretch.T),
                        lists(order, pa.int64()), lists(np.arange(len(gram)), pa.int32())], names=["part", "pack", "gram", "stretch1", "stretch2", "order", "number"])

    def met(batches):
        """Part after part; the rows of one are adjacent."""
        held, current = [], None
        for batch in batches:
            parts = np.asarray(batch.column(0))
            edges = np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(parts)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b > a:
                    if held and parts[a] != current:
                        yield resolved(held)
                        held = []
                    held.append(batch.slice(a, b - a))
                    current = parts[a]
        if held:
            yield resolved(held)

    def resolved(batches):
        flat = lambda name: np.concatenate([np.asarray(b.column(name).flatten()) for b in batches])
        sizes = np.concatenate([pc.list_value_length(b.column("gram")).to_numpy(zero_copy_only=False) for b in batches])
        gram, s1, s2, order = (flat(c) for c in ("gram", "stretch1", "stretch2", "order"))
        by = np.lexsort((order, s2, s1, gram))
        g, s1, s2, o = gram[by], s1[by], s2[by], order[by]
        new_gram = np.r_[True, g[1:] != g[:-1]]
        new = new_gram | np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        again = o > o[first]
        which = np.cumsum(new_gram) - 1
        several = np.bincount(which, new)[which] > 1
        kind = np.zeros(len(by), np.int8)
        kind[by] = np.where(again, 1, np.where(several, 2, 0))  # back in the order of the packs
        number, row = flat("number"), np.repeat(np.arange(len(sizes)), sizes)
        lists = []
        for k in (1, 2):
            at = np.flatnonzero(kind == k)
            ends = np.r_[0, np.cumsum(np.bincount(row[at], minlength=len(sizes)))]
            lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(number[at])))
        pack = pa.array(np.concatenate([np.asarray(b.column("pack")) for b in batches]))
        return pa.RecordBatch.from_arrays([pack, *lists], names=["pack", "repeated", "open"])

    rows = packs.select("pack", "orders", "sizes", "text").mapInArrow(listed, "part int, pack bigint, gram array<bigint>, stretch1 array<bigint>, stretch2 array<bigint>, order array<bigint>, number array<int>")
    dealt = rows.repartition(max(ranges, partitions(packs.sparkSession)), "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(met, "pack bigint, repeated array<int>, open array<int>")
    return found.groupBy("pack").agg(F.flatten(F.collect_list("repeated")).alias("repeated"), F.flatten(F.collect_list("open")).alias("open"))  # a pack's own anchors


# --- 3. Suffixes ----------------------------------------------------------------------------------------------


def suffixes(packs: DataFrame, found: DataFrame) -> DataFrame:
    """The open suffixes: t0 .. t3 (the anchor's tokens, ordered as its bytes), bytes (of its stretch), place (of the anchor in it), order,
    pack, doc, start (both within the pack), n (windows)."""

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pack, orders, sizes, text, numbers = _pack(batch, k, 5)
                start, n, place, _, _, doc = anchors(text, np.array(sizes, np.int64))
                at = np.unique(np.array(numbers, np.int64))
                order = np.array(orders, np.int64)[doc[at]]
                for k in range(0, len(at), 20_000):
                    own = at[k : k + 20_000]
                    grams = np.frombuffer(b"".join([text[p : p + GRAM] for p in place[own].tolist()]), ">u8").reshape(-1, GRAM // TOKEN).astype(np.uint64)
                    grams = (grams ^ _SIGN).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array(grams[:, c]) for c in range(grams.shape[1])),
                        pa.array([text[a:b] for a, b in zip(start[own].tolist(), (start[own] + n[own] + WINDOW - 1).tolist())], pa.binary()),
                        pa.array((place[own] - start[own]).astype(np.int32)), pa.array(order[k : k + 20_000]), pa.array(np.full(len(own), pack, np.int64)),
                        pa.array(doc[own].astype(np.int32)), pa.array(start[own].astype(np.int32)), pa.array(n[own].astype(np.int32))],
                        names=["t0", "t1", "t2", "t3", "bytes", "place", "order", "pack", "doc", "start", "n"])

    joined = packs.join(found.where(F.size("open") > 0).select("pack", "open"), "pack").select("pack", "orders", "sizes", "text", "open")
    return joined.mapInArrow(cut, "t0 bigint, t1 bigint, t2 bigint, t3 bigint, bytes binary, place int, order bigint, pack bigint, doc int, start int, n int")


def tokens_of(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of big-endian tokens, closed by zero bytes."""
    return np.frombuffer(b"".join([s[:width].ljust(width, b"\0") for s in strings]), ">u8").reshape(len(strings), -1).astype(np.uint64)


def multikey_sort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows: by the first token, then each run of equals by the next token, and so on. Runs are split
    all at once, and rows that are alone are done, as in multikey quicksort's recursion into the equal part."""
    order = np.arange(len(tokens))
    run = np.zeros(len(tokens), np.int64)  # number of the run that a place of the order lies in
    left = np.arange(len(tokens))  # places in runs of several
    for column in range(tokens.shape[1]):
        if not len(left):
            break
        key = tokens[order[left], column]
        by = np.lexsort((key, run[left]))
        order[left] = order[left[by]]
        key, runs = key[by], run[left]
        new = np.r_[True, (key[1:] != key[:-1]) | (runs[1:] != runs[:-1])]
        edges = np.flatnonzero(new)
        sizes = np.diff(np.r_[edges, len(left)])
        run[left] = left[np.repeat(edges, sizes)]  # a run is named by its first place
        left = left[np.repeat(sizes > 1, sizes)]
    return order


def compared(rows: dict[str, np.ndarray | list], by: np.ndarray):
    """Repeated windows of one anchor string, rows `by` in order of (order, pack, doc, start): (row, first window, windows)."""
    seen: dict[bytes, int] = {}  # a window's first row; of several documents of one order, in the last of them
    strings, n, order, pack, doc, start = (rows[c] for c in ("bytes", "n", "order", "pack", "doc", "start"))
    for r in by.tolist():
        s, since = strings[r], None
        for j in range(n[r]):
            q = seen.setdefault(s[j : j + WINDOW], r)
            again = q != r and (order[q] < order[r] or (pack[q] == pack[r] and doc[q] == doc[r] and start[q] < start[r]))
            if q != r and not again:
                seen[s[j : j + WINDOW]] = r
            if again and since is None:
                since = j
            elif not again and since is not None:
                yield r, since, j - since
                since = None
        if since is not None:
            yield r, since, int(n[r]) - since


def sorted_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Open suffixes -> pack, start, n of repeated windows (w1 null), or w1, w2 (digest), order, pack, doc, start of a
    window that other buckets may have as well."""
    names = ["bytes", "order", "pack", "doc", "start", "n"]
    out = ["w1", "w2", "order", "pack", "doc", "start", "n"]

    def resolved(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        rows = {c: table.column(c).to_numpy() for c in names if c != "bytes"}
        cut = np.asarray(table.column("long"))
        rows["bytes"] = table.column("bytes").to_pylist()
        places = np.asarray(table.column("place"))
        grams = np.stack([table.column(f"t{c}").to_numpy().view(np.uint64) ^ _SIGN for c in range(GRAM // TOKEN)], 1)  # as the range partitioning orders them
        after = tokens_of([s[p + GRAM :] for s, p in zip(rows["bytes"], places.tolist())], WINDOW - GRAM + (-(WINDOW - GRAM)) % TOKEN)
        order = multikey_sort(np.hstack([grams, after]))
        sorted_grams = grams[order]
        edges = np.flatnonzero(np.r_[True, (sorted_grams[1:] != sorted_grams[:-1]).any(1)])
        ends = np.r_[edges[1:], len(order)]
        made, open_rows = [], []
        for a, b in zip(edges.tolist(), ends.tolist()):
            own = order[a:b]
            own = own[np.lexsort((rows["start"][own], rows["doc"][own], rows["pack"][own], rows["order"][own]))]
            across_buckets = cut[own[0]]
            for k in range(0, len(own), LONG_RUN):
                part = own[k : k + LONG_RUN]
                found = list(compared(rows, part)) if len(part) > 1 else []
                made.extend(found)
                if across_buckets:  # of each window its first one here: the others are settled
                    left = {r: np.ones(rows["n"][r], bool) for r in part.tolist()}
                    for r, j, n in found:
                        left[r][j : j + n] = False
                    open_rows.extend((r, j) for r, w in left.items() for j in np.flatnonzero(w).tolist())
        if made:
            r, j, n = (np.array(x, np.int64) for x in zip(*made))
            none = pa.nulls(len(r), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(rows["order"][r]), pa.array(rows["pack"][r]), pa.array(rows["doc"][r]), pa.array((rows["start"][r] + j).astype(np.int32)), pa.array(n.astype(np.int32))], names=out)
        digest = xxhash.xxh3_128_digest
        for k in range(0, len(open_rows), 50_000):
            own = open_rows[k : k + 50_000]
            d = np.frombuffer(b"".join([digest(rows["bytes"][r][j : j + WINDOW]) for r, j in own]), ">i8").reshape(-1, 2).astype(np.int64)
            at, j = np.array(own, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(rows["order"][at]), pa.array(rows["pack"][at]), pa.array(rows["doc"][at]), pa.array((rows["start"][at] + j).astype(np.int32)), pa.array(np.ones(len(at), np.int32))], names=out)

    # Equal keys share a bucket; the splitters are sampled over all of the key, so that a long anchor string may fill several.
    anchor = [f"t{c}" for c in range(GRAM // TOKEN)]
    long = rows.groupBy(*anchor).count().where(F.col("count") > LONG_RUN).select(*anchor, F.lit(True).alias("long"))  # one for LONG_RUN rows at most
    marked = rows.join(F.broadcast(long), anchor, "left").withColumn("long", F.col("long").isNotNull())
    dealt = marked.repartitionByRange(buckets, *anchor, F.when(F.col("long"), F.xxhash64("bytes")), F.when(F.col("long"), F.col("order")))
    return dealt.mapInArrow(resolved, "w1 bigint, w2 bigint, order bigint, pack bigint, doc int, start int, n int")


def across(found: DataFrame) -> DataFrame:
    """pack, start, n: all repeated windows of sorted_buckets(), those across buckets compared by digest."""
    open_windows = found.where("w1 is not null")
    first = (open_windows.groupBy("w1", "w2").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("rows"))
             .where("rows > 1").drop("rows"))  # a window alone repeats nothing
    own = open_windows.groupBy("w1", "w2", "order", "pack", "doc").agg(F.sort_array(F.collect_list("start")).alias("starts"))  # of one text
    again = F.when(F.col("order") > F.col("first"), F.col("starts")).otherwise(F.slice("starts", 2, 2**31 - 1))
    late = own.join(first, ["w1", "w2"]).select("pack", F.explode(again).alias("start"), F.lit(1).alias("n"))
    return found.where("w1 is null").select("pack", "start", "n").union(late)


# --- 4. Texts -------------------------------------------------------------------------------------------------


def removed(text: bytes, orders, sizes, repeated, windows) -> tuple[np.ndarray, np.ndarray]:
    """Of a pack: which bytes go; and the ends of its texts."""
    sizes = np.array(sizes, np.int64)
    start, n, _, _, stretch, doc = anchors(text, sizes)
    by, known = settled(stretch, np.array(orders, np.int64)[doc], doc, start)
    gone = np.r_[by[known], np.array(repeated or [], np.int64)]
    begin = np.concatenate([start[gone], np.array([w["start"] for w in windows or []], np.int64)])
    end = np.concatenate([(start + n)[gone], np.array([w["start"] + w["n"] for w in windows or []], np.int64)]) + WINDOW - 1
    change = np.bincount(begin, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1)
    return np.cumsum(change)[: len(text)] > 0, np.cumsum(sizes)


def kept(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `whole` also kept (the
    remaining bytes) and spans (array of start, end). One row for each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType
    packs = packs_of(docs)
    found = saved(stretches(packs, partitions(spark, 64)), "suffix-stretches")
    rows = saved(suffixes(packs, found), "suffix-rows")
    repeats = saved(sorted_buckets(rows, partitions(spark, 1 + rows.count() // ROWS)), "suffix-windows")
    windows = across(repeats).groupBy("pack").agg(F.collect_list(F.struct("start", "n")).alias("windows"))  # a pack's own
    joined = packs.join(found.select("pack", "repeated"), "pack", "left").join(windows, "pack", "left").select("orders", "sizes", "text", "repeated", "windows", "ids")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * whole

    def final(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                orders, sizes, text, repeated, windows, ids = _pack(batch, k, 6)
                gone, ends = removed(text, orders, sizes, repeated, windows)
                codes, made = np.frombuffer(text, np.uint8), []
                for end, size in zip(ends.tolist(), sizes):
                    own = gone[end - size : end]
                    n = int(own.sum())
                    rest = codes[end - size : end][~own].tobytes() if n else text[end - size : end]
                    edges = np.flatnonzero(np.diff(np.r_[False, own, False])).reshape(-1, 2) if n else np.empty((0, 2), np.int64)
                    row = (size, n, len(edges), hashlib.sha256(rest).hexdigest())
                    made.append((*row, rest, [{"start": a, "end": b} for a, b in edges.tolist()]) if whole else row)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span]
                yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), *(pa.array(c, t) for c, t in zip(zip(*made), types))], names=names)

    schema = f"doc_id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary, spans array<struct<start:bigint,end:bigint>>" * whole
    return joined.mapInArrow(final, schema)
