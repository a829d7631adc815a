"""Byte-level BPE encoding and decoding by longest match with backtracking.

Greedy merging by rank is reproduced without running it on the text. A token
sequence is the merge result of its bytes exactly if every two neighbours are
compatible, that is if merging their joined bytes gives the same two tokens
back: a first merge across some border would also be the first one across it
in that pair alone. It follows that each prefix of the bytes has one valid
sequence at most, so a search that takes the longest matching token first and
steps back on a dead end has to enter every position only once. All matches
come from one Aho-Corasick pass over the bytes mapped to Latin-1 characters,
and compatibility of two tokens is memoised, so a piece takes linear time.

Nulls and empty texts have no tokens. Texts are encoded whole, whatever their
length; memory is bounded by one text and the bounded memos.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import body, prepare

#: Unicode White_Space, which is what the split patterns mean by \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Runs that the split pattern never crosses: a word with at most one space before it, or white space
#: (without the last one before a word, if there are more). What lies in a run is split by the pattern itself.
RUNS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

MEMO = 1 << 19  # runs whose ids a worker keeps, some 200 bytes each, and as many older ones
LONGEST = 32  # characters of a run that is kept
PAIRS = 1 << 18  # pairs of tokens whose compatibility a worker keeps


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Encodes and decodes by `ranks`; `pattern` splits a text before merging.

    `by_runs`: the pattern keeps to RUNS, so a run's ids don't depend on what is around it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, by_runs: bool = True):
        self.ranks, self.by_runs = ranks, by_runs
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matches.add_word(token.decode("latin-1"), (len(token), rank))
        self.matches.make_automaton()
        self.none = max(ranks.values(), default=0) + 1
        self.ends = lru_cache(len(ranks))(self._ends)
        self.compatible = lru_cache(PAIRS)(self._compatible)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.decimal = {rank: str(rank) for rank in self.tokens}

    def _ends(self, rank: int):
        """How a token's own merges change its first and its last part: for each merge its rank and the
        part after it, closed by a rank that no merge has. None if the merges don't lead to the token."""
        data, get, none = self.tokens[rank], self.ranks.get, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        first, last, firsts, lasts = parts[0], parts[-1], [], []
        while len(parts) > 1:
            order = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            if (low := min(order)) == none:
                return None
            at = order.index(low)  # the leftmost of the lowest
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            firsts.append((low, parts[0]))
            lasts.append((low, parts[-1]))
        return first, [*firsts, (none, None)], last, [*lasts, (none, None)]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives both tokens back: their own merges run side by side, lowest rank
        first and left before right, until all are done or a merge across the border comes first."""
        ends, none = self.ends, self.none
        if (a := ends(left)) is None or (b := ends(right)) is None:
            return False
        last, lasts, first, firsts = a[2], a[3], b[0], b[1]
        i = j = 0
        across = self.ranks.get(last + first, none)
        while True:
            low, high = lasts[i][0], firsts[j][0]
            if across < low and across <= high:
                return False
            if low <= high:
                if low == none:
                    return True
                part = lasts[i][1]
                i += 1
                if part is not last:
                    last = part
                    across = self.ranks.get(last + first, none)
            else:
                part = firsts[j][1]
                j += 1
                if part is not first:
                    first = part
                    across = self.ranks.get(last + first, none)

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        end, options = len(data), [[] for _ in data]
        for last, match in self.matches.iter(data.decode("latin-1")):
            options[last - match[0] + 1].append(match)  # ascending by size
        entered, path, at, compatible = bytearray(end + 1), [], 0, self.compatible
        while at < end:
            left = options[at]
            while left:
                size, rank = left.pop()
                if not entered[at + size] and (not path or compatible(path[-1], rank)):
                    path.append(rank)
                    at += size
                    entered[at] = 1
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                at -= len(self.tokens[path.pop()])
        return tuple(path)

    def run(self, text: str) -> tuple[int, ...]:
        if (ids := self.older.get(text)) is None:
            ids = tuple([i for piece in self.pieces(text) for i in self.piece(piece.encode())])
        if len(text) <= LONGEST:
            if len(self.memo) >= MEMO:  # what is used again comes back from the older half
                self.older, self.memo = self.memo, {}
            self.memo[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not self.by_runs:
            return [i for piece in self.pieces(text) for i in self.piece(piece.encode())]
        run, ids = self.run, []
        for text_run in RUNS.findall(text):
            ids += self.memo.get(text_run) or run(text_run)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_KEPT: dict[str, Encoder] = {}  # the last encoder of this Python worker, kept from task to task


def _encoder(key: str, ranks: dict[bytes, int], pattern: str, by_runs: bool) -> Encoder:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(ranks, pattern, by_runs)
    return _KEPT[key]


def _over(docs: DataFrame, ranks: dict[bytes, int], pattern: str, by_runs: bool, schema: str, row, types) -> DataFrame:
    """Rows that row(encoder, text) makes of every text, with its doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    # bounded by the vocabulary, whatever the corpus: about 1 MB for 50,000 tokens
    shared = spark.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern, by_runs)).encode()).hexdigest()

    def encode(batches):
        encoder = _encoder(key, shared.value, pattern, by_runs)
        for batch in batches:
            made = [row(encoder, bytes(text).decode()) for text in batch.column(1).to_pylist()]
            columns = list(zip(*made)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[f"c{i}" for i in range(len(types) + 1)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [s.split()[0] for s in schema.split(", ")]
    made = docs.select("doc_id", body()).mapInArrow(encode, f"c0 {kind}, " + ", ".join(f"c{i} {s.split()[1]}" for i, s in enumerate(schema.split(", "), 1)))
    return made.toDF("doc_id", *names)


def _digests(encoder: Encoder, text: str):
    ids = encoder.encode(text)
    return len(ids), hashlib.sha256(",".join(map(encoder.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def _round_trip(encoder: Encoder, text: str):
    ids = encoder.encode(text)
    return ids, len(ids), encoder.decode(ids).decode("utf-8", "replace")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, by_runs: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, ids array<int>, n_tokens, decoded string: every whole text's ids and
    their decoding. One row for each row of docs, whatever its doc_id; null and empty texts have no ids."""
    return _over(docs, ranks, pattern, by_runs, "ids array<int>, n_tokens bigint, decoded string", _round_trip, [pa.list_(pa.int32()), pa.int64(), pa.string()])


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, by_runs: bool = True) -> DataFrame:
    """As encode(), but doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded bytes), so that nothing of a text's size is returned."""
    return _over(docs, ranks, pattern, by_runs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests, [pa.int64(), pa.string(), pa.string()])
