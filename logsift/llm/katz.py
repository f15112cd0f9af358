"""Language-model scores from a Katz backoff model of word pairs.

Counts are discounted by Good-Turing, and the mass that the discounts free after a history is given
to the words not seen after it, in proportion to their own probabilities, so every history's
probabilities sum to one:

    P(w | h) = scale(h) d(c(h, w)) c(h, w)   if the pair was seen
               alpha(h) P(w)                 if not

The model has two levels of pairs. In the lower one, words below a share of all training tokens are one
class; inside the class a word has its own discounted share, and one event stands for all words never
seen. The upper level has every pair of words that the class hides, with the same discounts, and backs off
to the lower one: after a rare word its group are all words, after a frequent word the rare ones.

Texts are read once. Their words are numbered and stored in chunks of some million tokens, and a chunk is the unit of
all that follows: it asks for the counts of its different words, then of its different pairs. The questions are dealt
into buckets by word or pair, a bucket adds up what its chunks have counted, and the answers return in the order of
the questions. So neither a token nor a pair is ever a row, and sums per text are made where the text is. What the
shares bound in number (words and pairs above a share of all tokens cannot be more than its inverse) is sent to every
task. Nothing whose number grows with the corpus reaches the driver or a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import arrow_batch, blobs, id_remainder, release, released
from logsift.llm.packing import gaps, joined, packed, unpacked
from logsift.sources.scratch import materialize, scratch_scope

#: Words with these shares of the training tokens: counts sent to the tasks; words of the pair model.
KNOWN_SHARE, VOCABULARY_SHARE = 5e-7, 1e-5
#: Pairs with this share of the training tokens: counts sent to the tasks.
PAIR_SHARE = 5e-7
CUTOFF = 5  # counts above it are not discounted
HELD_OUT = (10, 0)
START, OTHER, FIRST = 0, 1, 2  # model ids: before a text, class of rare words, first word
SHIFT = 20  # a pair's key is history << SHIFT | word
CHUNK = 2_000_000  # tokens that a task holds at a time
BUCKET = 4_000_000  # tokens of the corpus to a bucket at most
END = b" "  # no word holds a space
TEXTS, WORDS, LOWER, UPPER = 0, 1, 2, 3  # what a row of a chunk holds: its texts, or answers
STATS = -1  # in place of a chunk: sums that a bucket gives to the model
ROW = "chunk long, kind int, bucket int, blob binary"
ROW_SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
LEAST = 1e-12  # a share below it is none
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_key(word: bytes) -> int:
    """63 bits that stand for a word."""
    return xxhash.xxh64_intdigest(word) >> 1


class Numbers(dict):
    """Numbers of words, in the order in which they come first."""

    def __missing__(self, word):
        self[word] = value = len(self)
        return value

    def text(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        words.append(END)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def good_turing(n: list[float]) -> np.ndarray:
    """Discount factors for counts 0..CUTOFF from the numbers of types with counts 1..CUTOFF+1.

    A factor that the formula puts outside (0, 1] stays 1, as does every factor without singletons.
    """
    d = np.ones(CUTOFF + 1)
    if not n[0]:
        return d
    tail = (CUTOFF + 1) * n[CUTOFF] / n[0]
    for r in range(1, CUTOFF + 1):
        if n[r - 1] and tail < 1:
            value = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
            if 0 < value <= 1:
                d[r] = value
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    counts = np.asarray(counts)
    return np.where(counts > CUTOFF, 1.0, d[np.minimum(counts, CUTOFF)]) * counts


@dataclass
class Words:
    """Unigram model: totals, discounts, and the known words in the order of their keys."""

    total: int
    types: int
    discount: np.ndarray
    scale: float
    unseen: float
    keys: np.ndarray
    counts: np.ndarray
    model_ids: np.ndarray  # OTHER for words outside the pair model
    class_log: np.ndarray  # log10 P(w) by model id

    def base(self, counts):
        return np.log10((np.asarray(counts) + 0.1) / (self.total + 0.1 * (self.types + 1)))

    def log_word(self, counts) -> np.ndarray:
        """log10 P(w) of words with these training counts; count 0 is the event of an unseen word."""
        mass = discounted(counts, self.discount) * self.scale
        return np.log10(np.where(np.asarray(counts) > 0, mass, self.unseen))

    def ids(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), OTHER, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.model_ids[at], OTHER)

    def log_inside(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(w | class of w): 0 for a word of the lower level."""
        return np.where(ids == OTHER, self.log_word(counts) - self.class_log[OTHER], 0.0)


@dataclass
class Pairs:
    """Pair model: discounts, scale and alpha by history, and the pairs that tasks know."""

    discount: np.ndarray
    scale_log: np.ndarray
    alpha_log: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    def log_pair(self, keys: np.ndarray, counts: np.ndarray, words: Words) -> np.ndarray:
        history, word = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
        seen = self.scale_log[history] + np.log10(np.maximum(discounted(counts, self.discount), 1e-300))
        return np.where(counts > 0, seen, self.alpha_log[history] + words.class_log[word])

    def after_other(self, words: Words) -> np.ndarray:
        """log10 of the lower level's probabilities of all model ids after a rare word."""
        keys = (OTHER << SHIFT) | np.arange(len(words.class_log))
        return self.log_pair(keys, self.lookup(keys)[0], words)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs, and which of them are only to be had from the table.

        All pairs with the class of rare words are known, so one that is missing was not seen.
        """
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            counts = np.where(found, self.counts[at], 0)
        else:
            found, counts = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        return counts, ~found & ~with_other(keys)


def with_other(keys):
    return ((keys >> SHIFT) == OTHER) | ((keys & ((1 << SHIFT) - 1)) == OTHER)


def before(values: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """The value in front of each, ``start`` at the first of each text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = start
    return out


def mixed(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of numbers that need not be random."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def kept(c: np.ndarray, sizes: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    """What discounts leave of ``c`` events, of which ``sizes`` types have the counts 1..CUTOFF."""
    return c - sum((1 - d[r]) * r * n for r, n in enumerate(sizes[:CUTOFF], 1))


def sums_by(place: np.ndarray, c: np.ndarray, size: int) -> list[np.ndarray]:
    """By place the events, and the numbers of types with counts 1..CUTOFF+1."""
    rows = [np.bincount(place, c, size).astype(np.int64)]
    return rows + [np.bincount(place[c == r], minlength=size) for r in range(1, CUTOFF + 2)]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that wrote them has ended, not when the driver collects its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def _together(rows: DataFrame, by: str, run: Callable[[dict[str, list]], Iterator[tuple]], kind: str, schema: pa.Schema):
    """The rows that ``run`` makes of all rows with the same ``by``; it gets lists, in the order of kind, chunk and bucket."""

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in ("kind", "chunk", "bucket")])
        try:
            columns = list(zip(*run(table.to_pydict()), strict=True)) or [[]] * len(schema)
            arrays = [pa.array(values, field.type) for values, field in zip(columns, schema, strict=True)]
            return pa.Table.from_arrays(arrays, schema=schema)
        finally:
            release()

    return rows.groupBy(by).applyInArrow(group, kind)


@dataclass
class Chunk:
    """Texts whose tokens are places in a dictionary: the ascending keys of their words."""

    ids: np.ndarray  # of the texts
    null: np.ndarray
    apart: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray | None = None  # of the words in all training texts
    numbers: np.ndarray | None = None  # of the words in the corpus

    @classmethod
    def of(cls, ids, apart, texts: list[np.ndarray], words: dict[bytes, int]) -> Chunk:
        keys = np.fromiter(map(word_key, words), np.int64, len(words))
        order = np.argsort(keys)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        null = np.array([i is None for i in ids])
        ids = np.array([0 if i is None else i for i in ids], np.int64)
        return cls(ids, null, np.array(apart), np.array([len(x) for x in texts]), keys[order], place[np.concatenate(texts)])

    def blob(self) -> bytes:
        n = np.bincount(self.tokens, minlength=len(self.keys))
        rank = np.empty_like(n)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n))  # so the numbers of most tokens are small
        return packed(self.ids, self.null, self.apart, self.sizes, gaps(self.keys), n, rank[self.tokens])

    @classmethod
    def from_blob(cls, blob: bytes) -> Chunk:
        ids, null, apart, sizes, steps, n, ranks = unpacked(blob)
        return cls(ids, null.astype(bool), apart.astype(bool), sizes, np.cumsum(steps), np.argsort(-n, kind="stable")[ranks])

    def spread(self, of_texts: np.ndarray) -> np.ndarray:
        return np.repeat(of_texts, self.sizes)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


@dataclass
class Asked:
    """The different keys of a chunk, dealt into buckets, ascending in each."""

    at: np.ndarray  # tokens of the chunk that have a key
    which: np.ndarray  # and the places of their keys
    keys: np.ndarray
    n: np.ndarray  # training tokens with each key
    cuts: np.ndarray  # where the buckets begin, and the last one's end

    @classmethod
    def of(cls, chunk: Chunk, at: np.ndarray, keys: np.ndarray, bucket_of: Callable, buckets: int) -> Asked:
        found, which = np.unique(keys, return_inverse=True)
        n = np.bincount(which[~chunk.spread(chunk.apart)[at]], minlength=len(found))
        bucket = bucket_of(found)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return cls(at, place[which], found[order], n[order], np.searchsorted(bucket[order], np.arange(buckets + 1)))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of keys with the same upper half begin, and their places by key; a run is in one bucket."""
        upper = self.keys >> 32
        new = np.ones(len(upper), bool)
        new[1:] = upper[1:] != upper[:-1]
        return np.flatnonzero(new), np.cumsum(new) - 1


def _questions(chunk: Chunk, words: Words, buckets: int) -> tuple[np.ndarray, Asked, Asked, Asked]:
    """Model ids of the dictionary, and the pairs of the lower level, those after a rare word and before one."""
    ids = words.ids(chunk.keys)
    of_token = ids[chunk.tokens]
    history = before(of_token, chunk.starts, START)
    lower = Asked.of(
        chunk, np.arange(len(of_token)), (history << SHIFT) | of_token, lambda k: mixed(k, buckets), buckets
    )
    rare_bucket = mixed(chunk.numbers, buckets)
    by_word = lambda k: rare_bucket[k >> 32]
    after = np.flatnonzero(history == OTHER)
    after = Asked.of(chunk, after, (chunk.tokens[after - 1] << 32) | chunk.tokens[after], by_word, buckets)
    ahead = np.flatnonzero((of_token == OTHER) & (history != OTHER))
    ahead = Asked.of(chunk, ahead, (chunk.tokens[ahead] << 32) | history[ahead], by_word, buckets)
    return ids, lower, after, ahead


def _names(chunk: Chunk, ids: np.ndarray) -> np.ndarray:
    """What stands for the words of a dictionary in all chunks: model ids, and numbers above them for rare words."""
    return np.where(ids == OTHER, chunk.numbers + (1 << SHIFT), ids)


def cut_texts(rows: DataFrame) -> DataFrame:
    """Stored chunks of (doc_id, apart, text): rows of kind ``TEXTS``, and their numbers of training tokens."""
    schema = pa.schema([*ROW_SCHEMA, ("tokens", pa.int64()), ("training", pa.int64())])
    most = CHUNK

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0

        def chunk(ids, apart, texts, words):
            nonlocal made
            whole = Chunk.of(ids, apart, texts, words)
            row = {"chunk": [(task << 32) | made], "kind": [TEXTS], "bucket": [0], "blob": [whole.blob()]}
            made += 1
            return arrow_batch(schema, **row, tokens=[len(whole.tokens)], training=[int(whole.sizes[~whole.apart].sum())])

        held, size, words = ([], [], []), 0, Numbers()
        for batch in batches:
            columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2))
            for doc_id, apart, text in zip(*columns, strict=True):
                for part, value in zip(held, (doc_id, apart, words.text(text)), strict=True):
                    part.append(value)
                size += len(held[2][-1])
                if size >= most:
                    yield chunk(*held, words)
                    held, size, words = ([], [], []), 0, Numbers()
        if held[0]:
            yield chunk(*held, words)

    return materialize(rows.mapInArrow(released(run), f"{ROW}, tokens long, training long"), "chunks")


def _sums(chunks: DataFrame) -> tuple[int, int]:
    """Training tokens, and buckets for the questions of these chunks."""
    row = chunks.agg(F.sum("training").alias("training"), F.sum("tokens").alias("tokens")).first()
    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return row.training or 0, max(partitions, -(-(row.tokens or 0) // BUCKET))


def _stats(answers: DataFrame, columns: dict[str, type], first: int) -> DataFrame:
    """The arrays from ``first`` on that buckets gave to the model, a row per number."""
    schema = pa.schema([(x, pa.float64() if kind is float else pa.int64()) for x, kind in columns.items()])

    def run(batches):
        for batch in batches:
            for blob in blobs(batch.column(0)):
                arrays = unpacked(blob)[first : first + len(columns)]
                kinds = columns.values()
                arrays = [x.view(np.float64) if kind is float else x for x, kind in zip(arrays, kinds, strict=True)]
                yield arrow_batch(schema, **dict(zip(columns, arrays, strict=True)))

    kinds = ", ".join(f"{x} {'double' if kind is float else 'long'}" for x, kind in columns.items())
    return answers.filter(F.col("chunk") == STATS).select("blob").mapInArrow(run, kinds)


SIZES = [f"n{r}" for r in range(1, CUTOFF + 2)]
BY_HISTORY = {"h": int, "c": int, **dict.fromkeys(SIZES, int), "prior": float}


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    found = df.select(*names).toArrow()
    return [found.column(n).to_numpy() for n in names]


def _by_history(answers: DataFrame) -> list[np.ndarray]:
    """(h, c, [n1..], prior) of all buckets; there is a row for a word of the model at most."""
    found = _stats(answers, BY_HISTORY, 0).groupBy("h").agg(*[F.sum(x).alias(x) for x in BY_HISTORY if x != "h"])
    h, c, *sizes, prior = _columns(found, *BY_HISTORY)
    return [h, c, sizes, prior]


def count_words(chunks: DataFrame, sums: tuple[int, int]) -> tuple[Words, DataFrame]:
    """The unigram model, and to every word of every chunk its training count and its number as rows of ``WORDS``.

    The number of a word tells it from all others; the words of a bucket are numbered by falling counts.
    """
    total, buckets = sums
    least = KNOWN_SHARE * total

    def ask(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                chunk = Chunk.from_blob(blob)
                n = np.bincount(chunk.tokens[~chunk.spread(chunk.apart)], minlength=len(chunk.keys))
                edges = [(b << 63) // buckets + bool((b << 63) % buckets) for b in range(buckets)]
                cuts = [*np.searchsorted(chunk.keys, np.array(edges, np.int64)).tolist(), len(n)]
                parts = [packed(gaps(chunk.keys[a:b]), n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                row = {"chunk": [number] * buckets, "kind": [WORDS] * buckets, "bucket": range(buckets), "blob": parts}
                yield arrow_batch(ROW_SCHEMA, **{x: list(v) for x, v in row.items()})

    def answer(rows):
        parts = [unpacked(blob) for blob in rows["blob"]]
        sizes = [len(n) for _, n in parts]
        keys, which = np.unique(np.concatenate([np.cumsum(steps) for steps, _ in parts]), return_inverse=True)
        c = np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
        bucket = rows["bucket"][0]
        number = np.empty_like(c)
        number[np.argsort(-c, kind="stable")] = np.arange(len(c)) * buckets + bucket
        at = 0
        for chunk, size in zip(rows["chunk"], sizes, strict=True):
            own = which[at : at + size]
            yield chunk, WORDS, bucket, packed(c[own], number[own])
            at += size
        types = [np.array([(c > 0).sum()]), *(np.array([(c == r).sum()]) for r in range(1, CUTOFF + 2))]
        known = (c > 0) & (c >= least)
        yield STATS, WORDS, bucket, packed(*types, keys[known], c[known])

    asked = chunks.select("chunk", "blob").mapInArrow(released(ask), ROW)
    answers = materialize(_together(asked, "bucket", answer, ROW, ROW_SCHEMA), "words")
    names = ["types", *SIZES]
    row = _stats(answers, dict.fromkeys(names, int), 0).agg(*[F.sum(x).alias(x) for x in names]).first()
    types, n = row.types or 0, [row[x] or 0 for x in SIZES]
    d = good_turing(n)
    freed = sum((1 - d[r]) * r * n[r - 1] for r in range(1, CUTOFF + 1))
    # without any discount one more event makes room for an unseen word
    scale = 1 / total if freed > 0 else 1 / (total + 1)
    unseen = freed / total if freed > 0 else 1 / (total + 1)
    keys, known = _columns(_stats(answers, {"key": int, "c": int}, len(names)), "key", "c")
    order = np.argsort(keys)
    keys, known = keys[order], known[order]
    # the end of a text is a word of the pair model, however long the texts are
    inside = (known >= VOCABULARY_SHARE * total) | (keys == word_key(END))
    model_ids = np.full(len(keys), OTHER, dtype=np.int64)
    model_ids[inside] = FIRST + np.arange(int(inside.sum()))
    words = Words(total, types, d, scale, unseen, keys, known, model_ids, np.zeros(0))
    mass = discounted(known[inside], d) * scale
    other = max(unseen, 1 - float(mass.sum()))
    words.class_log = np.log10(np.concatenate(([1.0, other], mass)))
    return words, answers.filter(F.col("chunk") != STATS)


def back_off(c: np.ndarray, kept: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and alpha of histories with ``c`` events, of which discounts leave ``kept``.

    ``prior`` is the share that the words seen after the history have in the level below.
    """
    # a history whose words were all seen often frees nothing: one more event makes room
    room = np.where(kept < c - 1e-9, c, c + 1)
    left = 1 - prior
    every = left <= LEAST  # every word follows the history: nothing to back off to
    with np.errstate(divide="ignore"):  # a history that was not seen has nothing
        scale = np.where(every, 1 / kept, 1 / room)
    return scale, np.where(every, 1e-300, np.maximum((1 - kept / room), 1e-300) / np.where(every, 1, left))


def _told(rows: dict[str, list], sent) -> Chunk:
    """The chunk of a group's rows, with what it was told of its words."""
    kinds = rows["kind"]
    chunk = Chunk.from_blob(rows["blob"][kinds.index(TEXTS)])
    told = [blob for kind, blob in zip(kinds, rows["blob"], strict=True) if kind == WORDS]
    chunk.counts, chunk.numbers = joined(told, 2)
    return chunk


def ask_pairs(chunks: DataFrame, answers: DataFrame, words, buckets: int) -> DataFrame:
    """Stored questions (chunk, kind, bucket, lower, upper) for the counts of all pairs of both levels."""
    schema = pa.schema([*ROW_SCHEMA][:3] + [("lower", pa.binary()), ("upper", pa.binary())])

    def run(rows):
        chunk = _told(rows, words)
        ids, lower, after, ahead = _questions(chunk, words.value, buckets)
        names, counts = _names(chunk, ids), chunk.counts
        heads = [asked.runs() for asked in (after, ahead)]
        for b in range(buckets):
            part = slice(*lower.cuts[b : b + 2])
            upper = []
            for asked, (firsts, _) in zip((after, ahead), heads, strict=True):
                a, z = asked.cuts[b : b + 2]
                own = firsts[np.searchsorted(firsts, a) : np.searchsorted(firsts, z)]
                word, other = asked.keys[own] >> 32, asked.keys[a:z] & 0xFFFFFFFF
                upper += [names[word], np.diff(own, append=z), asked.n[a:z]]
                if asked is after:
                    upper += [names[other], np.where(ids[other] == OTHER, counts[other], 0)]
                else:
                    upper += [other, counts[word]]
            yield rows["chunk"][0], LOWER, b, packed(gaps(lower.keys[part]), lower.n[part]), packed(*upper)

    told = chunks.select("chunk", "kind", "bucket", "blob").unionByName(answers)
    kind = "chunk long, kind int, bucket int, lower binary, upper binary"
    return materialize(_together(told, "chunk", run, kind, schema), "questions")


def count_pairs(questions: DataFrame, words: Words, sent) -> tuple[Pairs, DataFrame]:
    """The pair model, and the training counts of all pairs of the lower level as rows of ``LOWER``.

    The counts of pairs that the model holds are not repeated in the answers.
    """
    least = PAIR_SHARE * words.total  # every training token ends one pair

    def answer(rows):
        parts = [unpacked(blob) for blob in rows["lower"]]
        sizes = [len(n) for _, n in parts]
        keys, which = np.unique(np.concatenate([np.cumsum(steps) for steps, _ in parts]), return_inverse=True)
        c = np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
        bucket = rows["bucket"][0]
        known = (c > 0) & ((c >= least) | with_other(keys))
        told = np.where(known, 0, c)
        at = 0
        for chunk, size in zip(rows["chunk"], sizes, strict=True):
            yield chunk, LOWER, bucket, packed(told[which[at : at + size]])
            at += size
        seen = c > 0
        h, place = np.unique(keys[seen] >> SHIFT, return_inverse=True)
        prior = np.bincount(place, 10 ** sent.value.class_log[keys[seen] & ((1 << SHIFT) - 1)], len(h))
        yield STATS, LOWER, bucket, packed(h, *sums_by(place, c[seen], len(h)), prior.astype(float), keys[known], c[known])

    lower = questions.select("chunk", "kind", "bucket", "lower")
    answers = materialize(_together(lower, "bucket", answer, ROW, ROW_SCHEMA), "pairs", keep=True)
    h, c, n, prior = _by_history(answers)
    d = good_turing([float(x.sum()) for x in n])
    scale, alpha = back_off(c, kept(c, n, d), prior)
    size = len(words.class_log)
    scale_log, alpha_log = np.zeros(size), np.zeros(size)
    scale_log[h], alpha_log[h] = np.log10(scale), np.log10(alpha)
    keys, known = _columns(_stats(answers, {"key": int, "c": int}, len(BY_HISTORY)), "key", "c")
    order = np.argsort(keys)
    return Pairs(d, scale_log, alpha_log, keys[order], known[order]), answers.filter(F.col("chunk") != STATS)


def count_rare_pairs(questions: DataFrame, words: Words, sent) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """The upper level: discounts, log10 scale and alpha after frequent words, and the answers as rows of ``UPPER``.

    After a rare word all pairs lie in the bucket of that word, which has its sums; pairs of a frequent and a rare word
    lie in the bucket of the rare one, and the sums of their histories, bounded by the lower level's share, are added up.
    The answers are the training counts of all pairs, and for every rare word of a chunk the events after it, the types
    with counts 1..CUTOFF, and the share of the words seen after it in the level below: 2 if that is everything, and left
    out (0) for a chunk that asks for no unseen pair after the word, as nothing is backed off there.
    """

    def answer(rows):
        words, pairs = sent.value
        parts = [unpacked(blob) for blob in rows["upper"]]
        word, runs, n, other, rare_c, word2, runs2, n2, history, word_c = (
            np.concatenate([part[i] for part in parts]) for i in range(10)
        )
        bucket = rows["bucket"][0]
        # after a rare word
        names, place = np.unique(word, return_inverse=True)
        keys, which = np.unique((np.repeat(place, runs) << 36) | other, return_inverse=True)
        c = np.bincount(which, n, len(keys)).astype(np.int64)
        own_c = np.zeros(len(keys), np.int64)
        own_c[which] = rare_c
        of_other = keys & ((1 << 36) - 1)
        ids = np.where(of_other < 1 << SHIFT, of_other, OTHER)
        seen = c > 0
        at = (keys >> 36)[seen]
        prior = 10 ** (words.log_inside(ids, own_c) + pairs.after_other(words)[ids])
        prior = np.bincount(at, prior[seen], len(names))
        sums = sums_by(at, c[seen], len(names))
        every = 1 - prior <= LEAST
        # a rare word after a frequent one
        names2, place2 = np.unique(word2, return_inverse=True)
        keys2, which2 = np.unique((np.repeat(place2, runs2) << 36) | history, return_inverse=True)
        c2 = np.bincount(which2, n2, len(keys2)).astype(np.int64)
        own_c2 = np.zeros(len(names2), np.int64)
        own_c2[place2] = word_c
        seen2 = c2 > 0
        at2 = (keys2 >> 36)[seen2]
        share = 10 ** words.log_inside(np.full(len(names2), OTHER), own_c2)
        h, by_h = np.unique(keys2[seen2] & ((1 << 36) - 1), return_inverse=True)
        prior2 = np.bincount(by_h, share[at2], len(h))
        sums2 = sums_by(by_h, c2[seen2], len(h))
        at_word = at_pair = at_pair2 = 0
        for chunk, part in zip(rows["chunk"], parts, strict=True):
            own = place[at_word : at_word + len(part[0])]
            counts = c[which[at_pair : at_pair + len(part[2])]]
            run = np.repeat(np.arange(len(own)), part[1])
            unseen = np.bincount(run[counts == 0], minlength=len(own)) > 0
            back = np.where(every[own], 2.0, np.where(unseen, prior[own], 0.0))
            counts2 = c2[which2[at_pair2 : at_pair2 + len(part[7])]]
            yield chunk, UPPER, bucket, packed(counts, *(x[own] for x in sums[:-1]), back, counts2)
            at_word, at_pair, at_pair2 = at_word + len(own), at_pair + len(counts), at_pair2 + len(counts2)
        # what is after rare words counts for the discounts, under their class
        h = np.append(h, OTHER)
        sums2 = [np.append(x, y.sum()) for x, y in zip(sums2, sums, strict=True)]
        yield STATS, UPPER, bucket, packed(h, *sums2, np.append(prior2, 0.0))

    upper = questions.select("chunk", "kind", "bucket", "upper")
    answers = materialize(_together(upper, "bucket", answer, ROW, ROW_SCHEMA), "rare-pairs", keep=True)
    h, c, n, prior = _by_history(answers)
    d = good_turing([float(x.sum()) for x in n])
    frequent = h != OTHER
    h, c, prior, n = h[frequent], c[frequent], prior[frequent], [x[frequent] for x in n]
    scale_log, alpha_log = np.zeros(len(words.class_log)), np.zeros(len(words.class_log))
    scale, alpha = back_off(c, kept(c, n, d), prior)
    scale_log[h], alpha_log[h] = np.log10(scale), np.log10(alpha)
    return d, scale_log, alpha_log, answers.filter(F.col("chunk") != STATS)


def _scores(told: DataFrame, buckets: int, words, pairs, upper) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) from the chunks and all that they were told."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("n_tokens", pa.int64()),
            ("n_known", pa.int64()),
            ("base_score", pa.float64()),
            ("score", pa.float64()),
        ]
    )

    def run(rows):
        own_words, own_pairs, (d, scale_log, alpha_log) = words.value, pairs.value, upper.value
        chunk = _told(rows, words)
        ids, lower, after, ahead = _questions(chunk, own_words, buckets)
        doc = chunk.spread(np.arange(len(chunk.sizes)))
        sums = lambda at, values: np.bincount(doc[at], values, len(chunk.sizes))
        answers = {kind: [b for k, b in zip(rows["kind"], rows["blob"], strict=True) if k == kind] for kind in (LOWER, UPPER)}
        every = slice(None)
        inside = own_words.log_inside(ids, chunk.counts)
        score = sums(every, inside[chunk.tokens])
        counts, asked = own_pairs.lookup(lower.keys)
        (told,) = joined(answers[LOWER], 1)
        score += sums(every, own_pairs.log_pair(lower.keys, np.where(asked, told, counts), own_words)[lower.which])

        c, events, *n, prior, c2 = joined(answers[UPPER], CUTOFF + 4)
        seen = np.log10(np.maximum(discounted(c, d), 1e-300))
        scale, alpha = map(np.log10, back_off(events, kept(events, n, d), prior.view(np.float64)))
        _, run = after.runs()
        word = after.keys & 0xFFFFFFFF
        below = inside[word] + own_pairs.after_other(own_words)[ids[word]]
        score += sums(after.at, np.where(c > 0, scale[run] + seen - below, alpha[run])[after.which])
        seen = np.log10(np.maximum(discounted(c2, d), 1e-300))
        word, h = ahead.keys >> 32, ahead.keys & 0xFFFFFFFF
        score += sums(ahead.at, np.where(c2 > 0, scale_log[h] + seen - inside[word], alpha_log[h])[ahead.which])

        known = np.bincount(doc[chunk.counts[chunk.tokens] > 0], minlength=len(chunk.sizes))
        base = sums(every, own_words.base(chunk.counts)[chunk.tokens])
        doc_id = pa.array(chunk.ids, mask=chunk.null).to_pylist()
        yield from zip(doc_id, chunk.apart.tolist(), chunk.sizes.tolist(), known.tolist(), base.tolist(), score.tolist(), strict=True)

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return _together(told, "chunk", run, kind, schema)


def _training(texts: DataFrame) -> DataFrame:
    return cut_texts(texts.select(F.lit(None).cast("long"), F.lit(False), F.col(texts.columns[0]).cast("binary")))


def fit_words(training: DataFrame) -> tuple[Words, DataFrame]:
    """The unigram model of a column of texts, and the answers to their words."""
    chunks = _training(training)
    return count_words(chunks, _sums(chunks))


def fit_pairs(training: DataFrame, words: Words) -> tuple[Pairs, DataFrame]:
    """The pair model of a column of texts, and the table (key, c) of all their pairs."""
    chunks = _training(training)
    sent = training.sparkSession.sparkContext.broadcast(words)
    sums = _sums(chunks)
    questions = ask_pairs(chunks, count_words(chunks, sums)[1], sent, sums[1])
    schema = pa.schema([("key", pa.int64()), ("c", pa.int64())])

    def counted(batches):
        for batch in batches:
            for blob in blobs(batch.column(0)):
                steps, n = unpacked(blob)
                yield arrow_batch(schema, key=np.cumsum(steps), c=n)

    counts = questions.select("lower").mapInArrow(counted, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    return count_pairs(questions, words, sent)[0], counts


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = HELD_OUT
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row.

    Texts whose id's crc32 has the held-out remainder do not train; a null id counts as the empty
    text and is held out. A null text is empty: one token, its end. ``base_score`` is the additive
    unigram score, ``score`` the model's log10 probability of the text. With nothing to train on, every
    token is the unseen event, of probability one. An empty table gives no rows. The rows are stored.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    apart = id_remainder(F.col("doc_id"), held_out[0]) == held_out[1]
    with scratch_scope(spark), shuffles_dropped(spark):
        chunks = cut_texts(rows.select("doc_id", apart.alias("apart"), "text"))
        sums = _sums(chunks)
        words, word_answers = count_words(chunks, sums)
        sent_words = context.broadcast(words)
        with scratch_scope(spark):  # the questions go when they are answered
            questions = ask_pairs(chunks, word_answers, sent_words, sums[1])
            pairs, pair_answers = count_pairs(questions, words, sent_words)
            sent_pairs = context.broadcast(pairs)
            both = context.broadcast((words, pairs))
            *upper, upper_answers = count_rare_pairs(questions, words, both)
        told = chunks.select("chunk", "kind", "bucket", "blob")
        for answers in (word_answers, pair_answers, upper_answers):
            told = told.unionByName(answers)
        scores = _scores(told, sums[1], sent_words, sent_pairs, context.broadcast(upper))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return materialize(scores.withColumn("train_tokens", F.lit(words.total).cast("long")).select(*names), "scores", keep=True)
