"""Vocabulary, document and location frequencies, and the weights made from them.

Everything the features need is counted in one pass over the corpus: occurrences are combined per
(token, position) on the map side, so a token that is in every line costs a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.functions.numeric import inverse_frequency
from logsift.operators.ranking import global_rank
from logsift.sources.scratch import materialize

# A vocabulary range covers 2**12 lines: even long lines then add a bounded number of new tokens.
VOCABULARY_SHIFT = 12
#: More tokens than Spark's threshold for broadcasts lets through, at some 50 bytes each.
LARGE_VOCABULARY = 200_000


def tokenize(corpus: DataFrame) -> DataFrame:
    """Replace ``message`` by its ``tokens`` array."""
    others = [c for c in corpus.columns if c != "message"]
    return corpus.select(*others, T.tokens(F.col("message")).alias("tokens"))


def token_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """One row per token: (keep..., pos, token), positions from 0."""
    return lines.select(*keep, F.posexplode("tokens").alias("pos", "token"))


def _occurrences(words: Column) -> Column:
    """Occurrences sorted by token, the first one of each token in the line flagged ``lead``."""
    pairs = F.sort_array(
        F.transform(words, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    )
    return T.bind(
        pairs,
        lambda s: F.transform(
            s,
            lambda p, i: F.struct(
                p["token"].alias("token"),
                p["pos"].alias("pos"),
                ((i == 0) | (F.get(s, i - 1)["token"] != p["token"])).alias("lead"),
            ),
        ),
    )


def term_counts(words: Column) -> Column:
    """array<struct<token, tf>> of one line, counted inside the row: no shuffle."""

    def runs(s: Column) -> Column:
        leads = F.filter(
            F.transform(s, lambda t, i: F.struct(t.alias("token"), i.alias("at"))),
            lambda p: (p["at"] == 0) | (F.get(s, p["at"] - 1) != p["token"]),
        )
        return T.bind(
            leads,
            lambda ls: F.transform(
                ls,
                lambda p, j: F.struct(
                    p["token"].alias("token"),
                    (F.coalesce(F.get(ls, j + 1)["at"], F.size(s)) - p["at"])
                    .cast("bigint")
                    .alias("tf"),
                ),
            ),
        )

    return T.bind(F.sort_array(words), runs)


def repeats(lines: DataFrame) -> bool:
    """Whether a text comes twice or more on average, as cleaned log lines do."""
    different = F.approx_count_distinct(F.xxhash64("tokens"))
    n_lines, n_texts = lines.agg(F.count("*"), different).first()
    return 2 * n_texts <= n_lines


def counted_texts(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., line_no, tokens, n): equal texts once, with their first line and their number."""
    return lines.groupBy(*by, "tokens").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))


def token_places(lines: DataFrame, by: Sequence[str] = (), n: Column | None = None) -> DataFrame:
    """Occurrences combined per (by..., token, pos), from ``(by..., line_no, tokens)``.

    ``first_line`` is the first line in which the position is the token's leftmost one. Lines
    without tokens are counted under a NULL token. ``n`` says how many lines a row stands for.
    """
    n = F.lit(1) if n is None else n
    return (
        lines.select(*by, "line_no", n.alias("n"), F.inline_outer(_occurrences(F.col("tokens"))))
        .groupBy(*by, "token", "pos")
        .agg(
            F.sum(F.when(F.col("lead"), F.col("n")).otherwise(0)).alias("df"),
            F.min(F.when(F.col("lead"), F.col("line_no"))).alias("first_line"),
            F.sum("n").alias("n"),
        )
    )


def place_width(lines: DataFrame) -> int | None:
    """A number of places per line with which ``line_no * width + pos`` of every token fits into 64 bits, if any.

    It reads the lines once, so they should be stored.
    """
    low, high, longest = lines.agg(F.min("line_no"), F.max("line_no"), F.max(F.size("tokens"))).first()
    width = max(1, longest or 0)
    return width if low is not None and low >= 0 and (high + 1) * width < 1 << 63 else None


def _training_sets(k: int, swap: bool) -> Column:
    """The training sets of a row of ``fold``: every one but that fold's own, or it alone when swapped."""
    splits = F.sequence(F.lit(0), F.lit(k - 1))
    return F.filter(splits, lambda s: (s == F.col("fold")) if swap else (s != F.col("fold")))


def training_places(places: DataFrame, k: int, swap: bool = False) -> DataFrame:
    """Per-fold places regrouped into the ``k`` training sets, as column ``split``.

    Training set i is every fold but i, or fold i alone when train and test are swapped.
    """
    return (
        places.withColumn("split", F.explode(_training_sets(k, swap)))
        .groupBy("split", "token", "pos")
        .agg(
            F.sum("df").alias("df"),
            F.min("first_line").alias("first_line"),
            F.sum("n").alias("n"),
        )
    )


def token_stats(places: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per token: ``df`` = lines with it, ``lf`` = different positions it takes, ``first_line`` and
    ``first_pos`` = where it is first seen, ``n_lines`` = lines that start with it (so the sum is
    the number of lines) and ``max_len`` = its largest position plus one, so the maximum is the
    length of the longest line.

    A token has one leftmost position per line, so the smallest ``first_line`` is unique and plain
    ``min_by`` finds its position; all buffers are primitive, so this stays a hash aggregation.
    """
    starts = (F.col("pos") == 0) | F.col("pos").isNull()
    return (
        places.groupBy(*by, "token")
        .agg(
            F.sum("df").alias("df"),
            F.count("pos").alias("lf"),
            F.min_by("pos", "first_line").alias("first_pos"),
            F.min("first_line").alias("first_line"),
            F.sum(F.when(starts, F.col("n")).otherwise(0)).alias("n_lines"),
            (F.max("pos") + 1).cast("bigint").alias("max_len"),
        )
    )


def batch_tokens(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The tokens of a batch of lines: their rows, positions and codes, and the token of each code."""
    rows = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    pos = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(tokens)))[rows]
    coded = pc.dictionary_encode(pc.list_flatten(tokens), null_encoding="encode")
    return rows, pos, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def batch_terms(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The different tokens of each line of a batch: rows, codes and counts, and the token of each code."""
    rows, _, code, words = batch_tokens(tokens)
    keys, tf = np.unique(rows * max(1, len(words)) + code, return_counts=True)
    return keys // max(1, len(words)), keys % max(1, len(words)), tf, words.cast(pa.string())


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, equal ones as they come, and where each different key begins in it."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))


#: Positions that share a 64-bit mask, and a line number above all.
MASK_SIZE, NO_LINE = 64, np.iinfo(np.int64).max
_BLOCKS = "token string, block int, mask long, df long, first_line long, first_pos int, n_lines long, last int"


def _position_blocks(batches):
    """What ``token_stats`` needs of each token and block of positions, combined per batch of lines."""
    names = [part.split()[0] for part in _BLOCKS.split(", ")]
    for batch in batches:
        lines, tokens = pc.fill_null(batch.column(0), NO_LINE).to_numpy(), batch.column(1)
        bare = len(tokens) - int(pc.sum(pc.greater(pc.list_value_length(tokens), 0)).as_py() or 0)
        if bare:
            columns = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), *[pa.array([0])] * 2, pa.nulls(1, pa.int64())]
            columns += [pa.nulls(1, pa.int32()), pa.array([bare]), pa.nulls(1, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)
        rows, pos, code, words = batch_tokens(tokens)
        if not len(rows):
            continue
        order, begins = _runs(rows * len(words) + code)
        lead = np.zeros(len(rows), bool)
        lead[order[begins]] = True
        blocks = int(pos.max()) // MASK_SIZE + 1
        order, begins = _runs(code * blocks + pos // MASK_SIZE)
        pos, lead, code = pos[order], lead[order], code[order]
        line = np.where(lead, lines[rows[order]], NO_LINE)
        first = np.minimum.reduceat(line, begins)
        own = lead & (line == np.repeat(first, np.diff(np.append(begins, len(line)))))
        none = first == NO_LINE
        bits = np.left_shift(np.uint64(1), (pos % MASK_SIZE).astype(np.uint64))
        columns = [
            words.take(pa.array(code[begins])).cast(pa.string()),
            pa.array((pos[begins] // MASK_SIZE).astype(np.int32)),
            pa.array(np.bitwise_or.reduceat(bits, begins).view(np.int64)),
            pa.array(np.add.reduceat(lead.astype(np.int64), begins)),
            pa.array(first, mask=none),
            pa.array(np.minimum.reduceat(np.where(own, pos, NO_LINE), begins).clip(max=2**31 - 1).astype(np.int32), mask=none),
            pa.array(np.add.reduceat((pos == 0).astype(np.int64), begins)),
            pa.array(np.maximum.reduceat(pos, begins).astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


def line_stats(lines: DataFrame) -> DataFrame:
    """``token_stats`` of ``(line_no, tokens)`` where each line counts once.

    The positions of a token are told apart by the bits of masks, 64 to a row, so a token takes one row of a
    batch for each block of positions, not one for every position.
    """
    kind = lines.schema["line_no"].dataType
    found = lines.select(F.col("line_no").cast("bigint"), "tokens").mapInArrow(_position_blocks, _BLOCKS)
    sums = [F.sum("df").alias("df"), F.min_by("first_pos", "first_line").alias("first_pos")]
    sums += [F.min("first_line").alias("first_line"), F.sum("n_lines").alias("n_lines"), F.max("last").alias("last")]
    blocks = found.groupBy("token", "block").agg(F.bit_or("mask").alias("mask"), *sums)
    return (
        blocks.groupBy("token")
        .agg(*sums, F.sum(F.bit_count("mask")).alias("lf"))
        .select(
            "token",
            "df",
            "lf",
            "first_pos",
            F.col("first_line").cast(kind).alias("first_line"),
            "n_lines",
            (F.col("last") + 1).cast("bigint").alias("max_len"),
        )
    )


def fit_stats(lines: DataFrame) -> DataFrame:
    """The stored token counts of a corpus ``(line_no, tokens)``."""
    return materialize(line_stats(lines), "token-stats")


def corpus_totals(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of lines and longest line in tokens."""
    return stats.groupBy(*by).agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.max("max_len"), F.lit(0)).alias("max_len"),
    )


def _numbered(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """The known tokens with ``idx``: their place in the order they are first seen."""
    known = stats.where(F.col("token").isNotNull()).drop("n_lines", "max_len")
    return global_rank(
        known, "first_line", ("first_pos",), by, shift=VOCABULARY_SHIFT, name="idx"
    )


def vocabulary(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., token, idx): tokens numbered in the order they are first seen."""
    return _numbered(stats, by).select(*by, "token", "idx")


def weights(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., token, idx, df, lf, idf, ilf) from stored token counts."""
    ranked = _numbered(stats, by)
    totals = corpus_totals(stats, by)
    if by:
        ranked = ranked.join(totals, list(by))
        n_lines, max_len = F.col("n_lines"), F.col("max_len")
    else:
        n_lines = totals.select("n_lines").scalar()
        max_len = totals.select("max_len").scalar()
    return ranked.select(
        *by,
        "token",
        "idx",
        "df",
        "lf",
        inverse_frequency(n_lines, F.col("df")).alias("idf"),
        inverse_frequency(max_len, F.col("lf")).alias("ilf"),
    )


def fit_weights(lines: DataFrame) -> DataFrame:
    """The stored vocabulary with its weights, ready to be joined to lines."""
    return materialize(weights(fit_stats(lines)), "weights")


def fit_split_weights(lines: DataFrame, k: int, swap: bool = False) -> DataFrame:
    """Vocabularies and weights of all ``k`` training sets, from one pass over stored ``(fold, ...)``.

    Where texts repeat themselves, each is cut into its tokens once per fold.
    """
    rows = lines.select("fold", "line_no", "tokens")
    if repeats(rows):
        places = token_places(counted_texts(rows, ["fold"]), ["fold"], F.col("n"))
    else:
        places = token_places(rows, ["fold"])
    places = training_places(places, k, swap)
    stats = materialize(token_stats(places, ["split"]), "token-stats")
    return materialize(weights(stats, ["split"]), "weights")


def line_terms(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep..., token, tf) for every different token of a line."""
    return lines.select(*keep, F.inline(term_counts(F.col("tokens"))))


def fit_split_vocabulary(lines: DataFrame, k: int, swap: bool = False) -> DataFrame:
    """(split, token, idx): the stored vocabularies of all ``k`` training sets of stored ``(fold, ...)``.

    The numbers alone need no frequencies: a token's first line and place in it are one integer, whose minimum
    is taken per fold and then per training set.
    """
    rows = lines.select("fold", "line_no", "tokens")
    width = place_width(rows)
    if width is None:
        return fit_split_weights(lines, k, swap).select("split", "token", "idx")
    place = F.min(F.col("line_no").cast("bigint") * width + F.col("pos")).alias("place")
    folds = token_rows(rows, "fold", "line_no").groupBy("fold", "token").agg(place)
    first = folds.withColumn("split", F.explode(_training_sets(k, swap))).groupBy("split", "token").agg(F.min("place").alias("place"))
    line, pos = F.expr(f"place DIV {width}"), (F.col("place") % width).cast("int")
    stats = materialize(first.select("split", "token", line.alias("first_line"), pos.alias("first_pos")), "first-places")
    return materialize(vocabulary(stats, ["split"]), "vocabulary")


def hashed_if_large(vocab: DataFrame) -> DataFrame:
    """A vocabulary to join tokens with: Spark's own threshold broadcasts a small one.

    A large one is hashed within its partitions, so that the tokens, which are many times as many, are not sorted.
    """
    return vocab.hint("shuffle_hash") if vocab.count() > LARGE_VOCABULARY else vocab


def vectorize(lines: DataFrame, vocab: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., line_no, pos, idx): tokens replaced by indexes, unknown ones dropped, positions closed up.

    ``by`` are columns of both: which of several vocabularies a line takes.
    """
    vocab = hashed_if_large(vocab.select(*by, "token", "idx"))
    known = token_rows(lines, *by, "line_no").join(vocab, [*by, "token"])
    place = Window.partitionBy("line_no").orderBy("pos")
    return known.select(*by, "line_no", (F.row_number().over(place) - 1).alias("pos"), "idx")
