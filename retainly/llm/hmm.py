"""A hidden Markov language model of word sequences.

STATES latent states pass into each other and emit words. Baum-Welch first runs
STEPS times over word classes (CLASSES buckets of the word's checksum), a model
of fixed size that every task can hold, which finds the states. A last pass
gathers the expected uses of every single word by state; Spark adds them up to a
table of one row a word, which grows with the corpus, stays distributed and
alone decides what a state emits. A word's shares of the states lean by LEAN
uses towards the states' overall shares and are kept in 255 steps each; its
mass over all states is its count and 0.1, as in the unigram base, and all
unknown words together have 0.1. The model is a distribution over all word
sequences, and the scaled forward recursion gives a text's exact log likelihood.

Texts are first cut into words and packed: a pack holds some PACK tokens as
places in a list of its own distinct words. Words by state come from the packs'
lists, and go back to them by a join on the word; a frequent word is one row
for each pack, not one for each use. A pack is named by its task and its number
there, so repeated rows make packs of their own. Training steps are passes over
the packs, whose tasks return expected counts of fixed size that Spark adds up.

Words are runs without ASCII white space, A-Z in lower case, then one end
token a text. Null texts count as empty (the end token alone); documents with
a null doc_id are training text. Repeated rows count as often as they occur.
An empty table gives an empty result; without training text all words are
unknown and the base score is 0.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import body, prepare, saved

STATES = 8
CLASSES = 4096  # of words, in the first steps; the end token's class is one more
STEPS = 3  # of Baum-Welch over classes, before the one over words
PACK = 3_000_000  # tokens
SLICE = 500_000  # tokens that are run through the recursions side by side
ADD = 0.1  # smoothing of word counts
LEAN = 0.5  # uses by which a word's shares of the states lean towards the overall ones
PRIOR = 10.0  # weight of the whole text's class shares in a state's
FINE = 64  # a pack's uses of a word by state are rounded to this part, so that sums are exact in any order
SEED = 5
END = b""  # the end token, the first word of each pack


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_class(word: bytes) -> int:
    return zlib.crc32(word) % CLASSES if word else CLASSES


def _squeezed(values: np.ndarray | bytes) -> bytes:
    """Compressed, with its length before it."""
    plain = values if isinstance(values, bytes) else values.tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _numbers(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_plain(data), kind)


# --- Packs ----------------------------------------------------------------------------------------------------


def packed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> pack long, doc_ids, held (array<boolean>), and compressed: sizes (int32, tokens of each
    text), words (joined by blanks, the end token first), classes (int16, of the words), codes (int32, the tokens' places in
    words), trained (int32, training uses of each word)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    types = [pa.int64(), pa.list_(to_arrow_type(kind)), pa.list_(pa.bool_()), *[pa.binary()] * 5]
    names = ["pack", "doc_ids", "held", "sizes", "words", "classes", "codes", "trained"]

    def made(name, ids, held, place, codes):
        seq, sizes = np.concatenate(codes), np.array([len(c) for c in codes], np.int32)
        train = np.repeat(~np.array(held, bool), sizes)
        uses = np.bincount(seq[train], minlength=len(place)).astype(np.int32)
        classes = np.fromiter(map(word_class, place), np.int16, len(place))
        row = [name, ids, held, *map(_squeezed, (sizes, b" ".join(place), classes, seq, uses))]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    def words_of():
        place = defaultdict()
        place.default_factory = place.__len__
        place[END]  # noqa: B018
        return place

    def pack(batches):
        name = TaskContext.get().partitionId() << 32
        ids, held, place, codes, n = [], [], words_of(), [], 0
        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = bytes(text).lower().split()
                words.append(END)
                codes.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(out)
                n += len(words)
                if n >= PACK:
                    yield made(name, ids, held, place, codes)
                    name += 1
                    ids, held, place, codes, n = [], [], words_of(), [], 0
        if ids:
            yield made(name, ids, held, place, codes)

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), body().alias("body")).mapInArrow(
        pack, f"pack bigint, doc_ids array<{kind.simpleString()}>, held array<boolean>, sizes binary, words binary, classes binary, codes binary, trained binary")


def _parts(arrays, names, size=100_000):
    for k in range(0, len(arrays[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + size]) for a in arrays], names=names)


def word_places(packs: DataFrame) -> DataFrame:
    """packs -> pack, place, word: a row for each pack and word of it."""

    def rows(batches):
        for batch in batches:
            for pack, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _plain(words.as_py()).split(b" ")
                yield from _parts([np.full(len(words), pack, np.int64), np.arange(len(words), dtype=np.int32), words], ["pack", "place", "word"])

    return packs.select("pack", "words").mapInArrow(rows, "pack bigint, place int, word binary")


def class_counts(packs: DataFrame) -> np.ndarray:
    """Training uses of each class."""

    def counts(batches):
        total = np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            for classes, trained in zip(batch.column(0), batch.column(1)):
                classes, trained = _numbers(classes.as_py(), np.int16), _numbers(trained.as_py(), np.int32)
                total += np.bincount(classes, trained, len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["class", "n"])

    total = np.zeros(CLASSES + 1, np.int64)
    rows = packs.select("classes", "trained").mapInArrow(counts, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # classes + 1 rows at most
        total[r["class"]] = r.n
    return total


# --- Recursions -----------------------------------------------------------------------------------------------


class Model:
    """start (states), move (states x states), emit (classes + 1, or a pack's words, by states)."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(shares: np.ndarray) -> Model:
        """States that tend to stay, each with the class shares shaken by a fixed seed."""
        rng = np.random.default_rng(SEED)
        emit = shares[:, None] * (0.5 + rng.random((len(shares), STATES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    def single(self) -> Model:
        """In single precision, which training needs no more than."""
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))

    def after(self, starts, moves, emits, shares) -> Model:
        """Re-estimated from expected counts."""
        start, move, emit = starts + 1, moves + 1, emits + PRIOR * shares[:, None]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Group:
    """Sequences of classes side by side, the longest first, in the order of time. classes: one after the other."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        longest = sizes[self.order]
        self.active = np.searchsorted(-longest, -np.arange(longest[0]), "left")  # sequences longer than t
        self.begin = np.r_[0, np.cumsum(self.active)]
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        t = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.classes = np.empty(len(classes), classes.dtype)
        self.classes[self.begin[t] + np.repeat(rank, sizes)] = classes

    def forward(self, model: Model):
        """(emissions, scaled alphas, scales) of all tokens."""
        emit = model.emit[self.classes]
        alpha, scale, ones = np.empty_like(emit), np.empty(len(emit), emit.dtype), np.ones(emit.shape[1], emit.dtype)
        for t, n in enumerate(self.active):
            b = self.begin[t]
            now = alpha[b : b + n]
            if t:
                np.matmul(alpha[self.begin[t - 1] : self.begin[t - 1] + n], model.move, out=now)
                now *= emit[b : b + n]
            else:
                np.multiply(emit[:n], model.start, out=now)
            total = now @ ones
            scale[b : b + n] = total
            now /= total[:, None]
        return emit, alpha, scale

    def likelihoods(self, model: Model) -> np.ndarray:
        """log10 of each sequence's probability, in the order given. Holds one alpha a sequence."""
        logs, alpha, ones = np.zeros(len(self.order)), None, np.ones(model.emit.shape[1])
        for b, n in zip(self.begin, self.active):
            now = model.emit[self.classes[b : b + n]]
            now *= model.start if alpha is None else alpha[:n] @ model.move
            scale = now @ ones
            logs[:n] += np.log10(scale)
            now /= scale[:, None]
            alpha = now
        made = np.empty(len(self.order))
        made[self.order] = logs
        return made

    def expected(self, model: Model):
        """Expected counts of starts, moves, and classes by state."""
        emit, alpha, scale = self.forward(model)
        beta = np.ones_like(alpha)
        back = model.move.T.copy()
        emit /= scale[:, None]
        moves = np.zeros(model.move.shape)
        for t in range(len(self.active) - 1, 0, -1):
            b, n, up = self.begin[t], self.active[t], self.begin[t - 1]
            ahead = emit[b : b + n]
            ahead *= beta[b : b + n]
            np.matmul(ahead, back, out=beta[up : up + n])
            moves += alpha[up : up + n].T @ ahead
        alpha *= beta
        emits = np.stack([np.bincount(self.classes, alpha[:, k], len(model.emit)) for k in range(alpha.shape[1])], 1)
        return alpha[: self.active[0]].sum(0, np.float64), moves * model.move, emits


def groups_of(held, sizes, codes, train: bool = False):
    """A pack's texts, or its training texts, in slices of like lengths: (numbers of the texts, their codes as a Group)."""
    kept = np.flatnonzero(~np.array(held, bool)) if train else np.arange(len(sizes))
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    kept = kept[np.argsort(sizes[kept], kind="stable")]
    for part in np.split(kept, np.flatnonzero(np.diff(np.cumsum(sizes[kept], dtype=np.int64) // SLICE)) + 1):
        if len(part):
            own = sizes[part].astype(np.int64)
            at = np.repeat(begin[part] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            yield part, Group(codes[at], own)


# --- Training and scoring -------------------------------------------------------------------------------------


def train(packs: DataFrame, shares: np.ndarray, steps: int = STEPS) -> Model:
    """Baum-Welch over the classes of all training texts of the packs. shares: of the classes."""
    spark = packs.sparkSession
    model = Model.first(shares)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(model)  # fixed size: states x classes

        def expected(batches, shared=shared):
            now = shared.value.single()
            starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
            for batch in batches:
                for held, sizes, classes, codes in zip(*batch.columns):
                    tokens = _numbers(classes.as_py(), np.int16)[_numbers(codes.as_py(), np.int32)]
                    for _, group in groups_of(held.as_py(), _numbers(sizes.as_py(), np.int32), tokens, train=True):
                        for total, part in zip((starts, moves, emits), group.expected(now)):
                            total += part
            rows = np.vstack([emits, moves, starts])
            used = np.flatnonzero(rows.sum(1) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(rows[used, k]) for k in range(STATES))], names=["row", *COLUMNS])

        counted = (packs.select("held", "sizes", "classes", "codes").mapInArrow(expected, "row int, " + ", ".join(f"{c} double" for c in COLUMNS))
                   .groupBy("row").agg(*(F.sum(c).alias(c) for c in COLUMNS)))
        total = np.zeros((CLASSES + 1 + STATES + 1, STATES))
        for r in counted.collect():  # classes + states + 2 rows at most
            total[r.row] = [r[c] for c in COLUMNS]
        model = model.after(total[-1], total[CLASSES + 1 : -1], total[: CLASSES + 1], shares)
    return model


COLUMNS = [f"s{k}" for k in range(STATES)]


def emissions(packs: DataFrame, model: Model, overall: np.ndarray) -> DataFrame:
    """word, uses, mix: of each training word, its uses and its shares of the states, a byte from 1 to 255 each, the first
    state's lowest. overall: the states' shares of all tokens."""
    shared = packs.sparkSession.sparkContext.broadcast(model)

    def expected(batches):
        now = shared.value.single()
        for batch in batches:
            for held, sizes, words, classes, codes, trained in zip(*batch.columns):
                trained, classes = _numbers(trained.as_py(), np.int32), _numbers(classes.as_py(), np.int16)
                by_word = Model(now.start, now.move, now.emit[classes])
                total = np.zeros(by_word.emit.shape)
                for _, group in groups_of(held.as_py(), _numbers(sizes.as_py(), np.int32), _numbers(codes.as_py(), np.int32), train=True):
                    total += group.expected(by_word)[2]
                total = np.rint(total * FINE) / FINE
                used = np.flatnonzero(trained)
                words = _plain(words.as_py()).split(b" ")
                words = [words[k] for k in used.tolist()]
                yield from _parts([words, trained[used].astype(np.int64), *total[used].T], ["word", "uses", *COLUMNS])

    rows = packs.select("held", "sizes", "words", "classes", "codes", "trained").mapInArrow(
        expected, "word binary, uses bigint, " + ", ".join(f"{c} double" for c in COLUMNS))
    summed = rows.groupBy("word").agg(F.sum("uses").alias("uses"), *(F.sum(c).alias(c) for c in COLUMNS))
    own = sum((F.col(c) for c in COLUMNS), F.lit(LEAN))
    mix = F.lit(0).cast("bigint")
    for k, c in enumerate(COLUMNS):
        share = (F.col(c) + F.lit(LEAN * float(overall[k]))) / own
        mix = mix.bitwiseOR(F.shiftleft(F.greatest(F.lit(1), F.round(255 * share)).cast("bigint"), 8 * k))
    return summed.select("word", "uses", mix.alias("mix"))


def masses(uses: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """Words x states: each word's count and ADD, dealt by its mix."""
    shares = np.ascontiguousarray(mix, "<i8").view(np.uint8).reshape(-1, STATES).astype(float)
    return (uses + ADD)[:, None] * shares / shares.sum(1, keepdims=True)


def state_masses(words: DataFrame, overall: np.ndarray) -> np.ndarray:
    """What each state's masses of all known words and of the unknown ones add up to."""
    share = [F.shiftrightunsigned("mix", 8 * k).bitwiseAND(F.lit(255)) for k in range(STATES)]
    whole = sum(share[1:], share[0])
    row = words.agg(*(F.sum((F.col("uses") + ADD) * share[k] / whole).alias(c) for k, c in enumerate(COLUMNS))).first()
    return np.array([row[c] or 0.0 for c in COLUMNS]) + ADD * overall


def scores(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. One row for
    each row of docs; the model learns from the rows that aren't held out."""
    spark = docs.sparkSession
    prepare(spark)
    packs = saved(packed(docs), "hmm-packs")
    n_of = class_counts(packs)
    total = int(n_of.sum())
    shares = (n_of + ADD) / (total + ADD * (CLASSES + 1))
    model = train(packs, shares, steps)
    overall = np.linalg.matrix_power(model.move, 1 << 10).mean(0)  # the shares that the moves settle at
    overall = overall / overall.sum()
    words = saved(emissions(packs, model, overall), "hmm-words")
    whole, known = state_masses(words, overall), words.count()

    # Each pack meets its own words' counts and mixes; both sides of a pack are bounded by PACK.
    found = word_places(packs).join(words, "word").select("pack", "place", "uses", "mix")
    kind = docs.schema["doc_id"].dataType
    parameters = (model.start, model.move, whole, overall, total, known)  # states x states

    def scored(pack: pa.Table, found: pa.Table) -> pa.Table:
        start, move, whole, overall, total, known = parameters
        base_of = np.log10(total + ADD * (known + 1))
        made = []
        for ids, held, sizes, codes in zip(*(pack.column(c) for c in ("doc_ids", "held", "sizes", "codes"))):
            held, sizes, codes = held.as_py(), _numbers(sizes.as_py(), np.int32), _numbers(codes.as_py(), np.int32)
            count = np.zeros(codes.max() + 1)
            emit = np.tile(ADD * overall / whole, (len(count), 1))
            place, uses, mix = (found.column(c).to_numpy() for c in ("place", "uses", "mix"))
            count[place] = uses
            emit[place] = masses(uses, mix) / whole
            doc = np.repeat(np.arange(len(sizes)), sizes)
            base = np.bincount(doc, (np.log10(count + ADD) - base_of)[codes], len(sizes))
            n_known = np.bincount(doc, (count > 0)[codes], len(sizes)).astype(np.int64)
            score, own = np.empty(len(sizes)), Model(start, move, emit)
            for part, group in groups_of(held, sizes, codes):
                score[part] = group.likelihoods(own)
            made.append(pa.Table.from_arrays([
                pa.array(ids.as_py(), to_arrow_type(kind)), pa.array(held, pa.bool_()), pa.array(sizes.astype(np.int64)), pa.array(n_known),
                pa.array(np.full(len(sizes), total, np.int64)), pa.array(base), pa.array(score)], names=names))
        return pa.concat_tables(made)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    bodies = packs.select("pack", "doc_ids", "held", "sizes", "codes")
    return bodies.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(
        scored, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
