"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and length >= max(SHORTEST, 2 q) that no neighbouring word
extends keeping period q. Every word of a run occurs in it at least twice, so a
word that occurs once within the current segment can't be part of a run: it
splits the segment. Segments under SHORTEST words go; the rest is counted and
split again until nothing changes, for all texts of a batch side by side.

Surviving segments are scanned by lag. Lags under GRAM compare all words. A run
with a longer period has at least GRAM words in a row that recur at its lag, so
longer lags look only at the places whose GRAM words occur again in their
segment. Where those recur too often for that (PAIRS places a word), a segment
is scanned lag by lag, at checkpoints half a lag apart whose words must recur
up to the next checkpoint. Every way finds the same runs. Stretches that a run
of a smaller period explains have the same borders as that run.

A text is worked through whole in one task, with some 10 bytes of memory a byte;
nothing is shuffled. Null and empty texts have no words and no runs. Repeated
rows and doc_ids are rows like any other, null ones too.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import body, prepare

SHORTEST = 12  # words of the shortest run
GRAM = 8  # words; longer lags are looked for by grams
PAIRS = 8  # places a word at most that grams are paired up for
BATCH = 200_000  # words that are worked on side by side


def split(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of texts one after another, and of each word's text -> places of the words that survive, and
    their segments' numbers, both ascending."""
    at, segment, settled, most = np.arange(len(words)), text, [np.empty(0, np.int64)], int(words.max(initial=0)) + 1
    while len(at):
        number = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(segment) != 0))])
        _, which, count = np.unique(number * most + words[at], return_inverse=True, return_counts=True)
        rare = count[which] < 2
        long = (np.bincount(number) >= SHORTEST)[number]
        whole = (np.bincount(number, rare) == 0)[number]
        settled.append(at[long & whole])
        going = long & ~whole & ~rare
        at, segment = at[going], number[going]
    at = np.sort(np.concatenate(settled))
    # Segments that touch had a rare word or a text's end between them, so gaps and texts tell them apart.
    return at, np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(text[at]) != 0))])[: len(at)]


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _doubled(name: np.ndarray, size: int) -> np.ndarray:
    """Names of all stretches of `size` words -> names of those of twice the size, equal for equal words."""
    pair = name[: len(name) - size] * (int(name.max(initial=0)) + 1) + name[size:]
    return np.unique(pair, return_inverse=True)[1].astype(np.int64)


def _grams(words: np.ndarray) -> np.ndarray:
    """A name for the GRAM words from each place on."""
    name, size = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while size < GRAM:
        name, size = _doubled(name, size), size * 2
    return name


def _lag_by_lag(words: np.ndarray, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of one segment with periods of GRAM and more; known: those with smaller ones."""
    n, found, borders = len(words), [], {(s, e) for s, e, _ in known}
    start, end, period = np.array(known, np.int64).reshape(-1, 3).T
    name, size = _grams(words), GRAM
    for q in range(GRAM, n // 2 + 1):
        step = q // 2
        while size * 2 <= step:
            name, size = _doubled(name, size), size * 2
        if size > step:  # the shortest of these lags: every place is looked at
            step = 1
        place = np.arange(0, len(name) - q, step)
        place = place[name[place] == name[place + q]]
        if len(place):
            explain = np.flatnonzero((q % period == 0) & (end - start > q))
            for k in explain:
                place = place[(place < start[k]) | (place + q >= end[k])]
        if len(place):
            for s, e in zip(*(x.tolist() for x in _stretches(words[: n - q] == words[q:]))):
                if e - s >= q and (s, e + q) not in borders:
                    found.append((s, e + q, q))
                    borders.add((s, e + q))
                    start, end, period = np.append(start, s), np.append(end, e + q), np.append(period, q)
    return found


def _pairs(place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places with equal keys, sorted by key and place -> the earlier place and the lag of each pair with a lag of GRAM or more."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    follow = np.repeat(first + count, count) - 1 - np.arange(len(key))  # equal ones further on
    begin, lag = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    here, further = np.flatnonzero(follow > 0), 1
    while len(here):
        gap = place[here + further] - place[here]
        begin.append(place[here][gap >= GRAM])
        lag.append(gap[gap >= GRAM])
        further += 1
        here = here[follow[here] >= further]
    return np.concatenate(begin), np.concatenate(lag)


def find(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of texts one after another, and of each word's text (ascending) -> start, end and period of
    each run, as places in `words`, ordered by start, then period."""
    at, segment = split(words, text)
    w, found = words[at], [[], [], []]

    def keep(s, e, q):
        """s, e: stretches whose words recur q places on."""
        enough = e - s >= np.maximum(SHORTEST - q, q)
        for into, values in zip(found, (s, e + q, np.broadcast_to(q, len(s)))):
            into.append(values[enough].astype(np.int64))

    for q in range(1, GRAM):
        if len(w) > q:
            keep(*_stretches((w[q:] == w[:-q]) & (segment[q:] == segment[:-q])), q)
    if len(w) >= 2 * GRAM:
        name = _grams(w)
        place = np.flatnonzero(segment[: len(name)] == segment[GRAM - 1 :])
        key = segment[place] * (int(name.max()) + 1) + name[place]
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        each = (count[which] - 1) / 2  # pairs by place
        often = np.bincount(segment[place], each, minlength=segment[-1] + 1) > PAIRS * np.bincount(segment)
        chosen = (each > 0) & ~often[segment[place]]
        begin, lag = _pairs(place[chosen], key[chosen]) if chosen.any() else (np.empty(0, np.int64),) * 2
        order = np.lexsort((begin, lag))
        begin, lag = begin[order], lag[order]
        if len(lag):
            first = np.flatnonzero(np.concatenate([[True], (np.diff(lag) != 0) | (np.diff(begin) != 1)]))
            last = np.append(first[1:], len(lag)) - 1
            keep(begin[first], begin[last] + GRAM, lag[first])
        small = [np.concatenate(x) for x in found]
        for k in np.flatnonzero(often):
            s, e = np.searchsorted(segment, [k, k + 1])
            own = (small[0] >= s) & (small[0] < e)
            for into, values in zip(found, np.array(_lag_by_lag(w[s:e], np.stack([small[0][own] - s, small[1][own] - s, small[2][own]], 1).tolist()), np.int64).reshape(-1, 3).T):
                into.append(values + (0 if into is found[2] else s))
    if not found[0]:
        return (np.empty(0, np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in found)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # Of equal stretches the one with the smallest period.
    own = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)])[: len(start)]
    start, end, period = start[own], end[own], period[own]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return at[start], at[end - 1] + 1, period


def looped(words: list[bytes], h: int) -> list[bytes]:
    """The words with a tail that repeats by the rule of h: from word a on, the p words there over and over."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _worked(texts: list[list[bytes]]):
    """Lists of words -> for each its runs (start, length, period) and its words without those that repeat."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = np.array([number[x] for t in texts for x in t], np.int64)
    borders = np.cumsum([0, *map(len, texts)])
    start, end, period = find(words, np.repeat(np.arange(len(texts)), np.diff(borders)))
    first = np.searchsorted(start, borders)
    for k, t in enumerate(texts):
        own = slice(first[k], first[k + 1])
        s, e, q = start[own] - borders[k], end[own] - borders[k], period[own]
        if len(s):
            edge = np.bincount(s + q, minlength=len(t) + 1) - np.bincount(e, minlength=len(t) + 1)
            t = [t[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
        yield [{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), (e - s).tolist(), q.tolist())], b" ".join(t)


def runs(docs: DataFrame, loop: Column | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, runs array<struct<start, length, period>> by start, then period, and collapsed:
    the words, joined by single spaces, that no run holds after its first period. One row for each row of docs.
    loop: a number h; texts are changed by looped() before (null: not)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def mapped(batches):
        ids, texts, size = [], [], 0

        def done():
            found = list(zip(*_worked(texts))) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, to_arrow_type(kind)), pa.array(found[0], pa.list_(run)), pa.array([x.decode("utf-8", "replace") for x in found[1]], pa.string())],
                names=["doc_id", "runs", "collapsed"])

        for batch in batches:
            for doc_id, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().split()
                ids.append(doc_id)
                texts.append(words if h is None else looped(words, h))
                size += len(words)
                if size >= BATCH or len(ids) >= 10_000:
                    yield from done()
                    ids, texts, size = [], [], 0
        if ids:
            yield from done()

    h = F.lit(None).cast("bigint") if loop is None else loop.cast("bigint")
    return docs.select("doc_id", body(), h).mapInArrow(
        mapped, f"doc_id {kind.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """runs() -> doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of runs and words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                    F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
