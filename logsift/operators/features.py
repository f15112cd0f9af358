"""Weighted bag-of-words features in long form: one row per non-zero cell.

The long table ``(line_no, block, idx, value)`` grows with the tokens, not with lines times
vocabulary, and any vocabulary size works. ``logsift.models.features`` builds the same values as
MLlib vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.vocabulary import LARGE_VOCABULARY, batch_terms, line_terms
from logsift.registry import features


@dataclass(frozen=True)
class TermFeature:
    """One column per vocabulary token: ``weight`` times the term count (or 1 when ``binary``).

    ``weight`` is an expression over the weights table: df, lf, idf, ilf.
    """

    weight: str
    binary: bool = False

    def value(self) -> Column:
        weight = F.expr(self.weight).cast("double")
        return weight if self.binary else F.col("tf") * weight


@dataclass(frozen=True)
class LineFeature:
    """One column per line, from the counts of its in-vocabulary terms.

    ``of_array`` is a function of the array of those counts.
    """

    of_array: Callable[[Column], Column]


# The feature names. "tf" is the number of lines with the token.
features.register("tfidf", TermFeature("idf"))
features.register("tfilf", TermFeature("ilf"))
features.register("tf", TermFeature("df", binary=True))
features.register(
    "length",
    LineFeature(lambda counts: F.aggregate(counts, F.lit(0.0), lambda total, n: total + n)),
)


def known_terms(lines: DataFrame, weights: DataFrame) -> DataFrame:
    """(line_no, token, tf, idx, df, lf, idf, ilf); tokens outside the vocabulary vanish.

    A small vocabulary is broadcast by Spark's own threshold. A large one is hashed within its partitions, so
    that the terms, which are many times as many, are not sorted by token.
    """
    if weights.count() > LARGE_VOCABULARY:
        weights = weights.hint("shuffle_hash")
    return line_terms(lines, "line_no").join(weights, "token")


def _grouped_terms(
    lines: DataFrame, weights: DataFrame, names: Sequence[str], place: Column, by: Sequence[str], texts: DataFrame
) -> DataFrame:
    """(line_no, by..., terms, line): the known terms of each line in one array, and its other columns.

    Terms and lines meet in one grouping by line, so there is one shuffle of thin rows and the tokens are not in
    it. A term holds ``at``, ``tf`` and a value for each term feature, ``v0``, ``v1``, ...
    """
    if not by and lines is texts and weights.count() > LARGE_VOCABULARY:
        return _gathered_terms(lines, weights, names, place)
    others = [c for c in lines.columns if c not in ("line_no", "tokens", *by)]
    line = F.struct("line_no", *others)
    known = known_terms(texts, weights)
    terms = [n for n in names if isinstance(features[n], TermFeature)]
    values = [features[n].value().alias(f"v{i}") for i, n in enumerate(terms)]
    term = F.struct(place.alias("at"), "tf", *values)
    kinds = {
        "term": known.select(term.alias("term")).schema["term"].dataType,
        "line": lines.select(line.alias("line")).schema["line"].dataType,
    }
    nothing = lambda kind: F.lit(None).cast(kinds[kind]).alias(kind)
    return (
        known.select("line_no", *by, term.alias("term"), nothing("line"))
        .unionByName(lines.select("line_no", *by, nothing("term"), line.alias("line")))
        .groupBy("line_no", *by)
        .agg(F.collect_list("term").alias("terms"), F.first("line", ignorenulls=True).alias("line"))
    )


def _gathered_terms(lines: DataFrame, weights: DataFrame, names: Sequence[str], place: Column) -> DataFrame:
    """``_grouped_terms`` of a large vocabulary: its most frequent tokens travel with the tasks.

    Their terms stay together, in one row per line, so only the rare tokens are rows that meet the vocabulary.
    ``LARGE_VOCABULARY`` bounds what is sent, whatever the size of the corpus.
    """
    others = [c for c in lines.columns if c not in ("line_no", "tokens")]
    line = F.struct("line_no", *others)
    terms = [features[n] for n in names if isinstance(features[n], TermFeature)]
    ratios = [F.expr(t.weight).cast("double").alias(f"v{i}") for i, t in enumerate(terms)]
    frequent = weights.orderBy(F.desc("df"), "idx").limit(LARGE_VOCABULARY)
    sent = frequent.select("token", place.cast("bigint").alias("at"), *ratios).toArrow().combine_chunks()
    held = lines.sparkSession.sparkContext.broadcast(sent)
    binary = [t.binary for t in terms]

    def known(tokens):
        rows, code, tf, words = batch_terms(tokens)
        index = pc.index_in(words, value_set=held.value.column("token").combine_chunks())
        return rows, code, tf, words, pc.fill_null(index, -1).to_numpy()[code]

    def together(batches):
        for batch in batches:
            rows, _, tf, _, at = known(batch.column(1))
            rows, tf, at = rows[at >= 0], tf[at >= 0], at[at >= 0]
            columns = [held.value.column("at").to_numpy()[at], tf]
            for i, once in enumerate(binary):
                ratio = held.value.column(f"v{i}").to_numpy()[at]
                columns.append(ratio if once else tf * ratio)
            ends = np.searchsorted(rows, np.arange(len(batch) + 1)).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["line_no", "at", "tf", *values])

    def apart(batches):
        for batch in batches:
            rows, code, tf, words, at = known(batch.column(1))
            rare = at < 0
            columns = [batch.column(0).take(pa.array(rows[rare])), words.take(pa.array(code[rare])), pa.array(tf[rare])]
            yield pa.RecordBatch.from_arrays(columns, ["line_no", "token", "tf"])

    values = [f"v{i}" for i in range(len(terms))]
    slim, kind = lines.select("line_no", "tokens"), lines.schema["line_no"].dataType.simpleString()
    arrays = ", ".join(f"{x} array<{'long' if x in ('at', 'tf') else 'double'}>" for x in ("at", "tf", *values))
    parts = ["at", "tf", *values]
    own = slim.mapInArrow(together, f"line_no {kind}, {arrays}").select("line_no", F.struct(*parts).alias("own"))
    at = place.cast("bigint").alias("at")
    term = F.struct(at, "tf", *[t.value().alias(v) for t, v in zip(terms, values, strict=True)])
    scarce = slim.mapInArrow(apart, f"line_no {kind}, token string, tf long")
    scarce = scarce.join(weights.hint("shuffle_hash"), "token")
    grouped = (
        own.unionByName(scarce.select("line_no", term.alias("term")), allowMissingColumns=True)
        .unionByName(lines.select("line_no", line.alias("line")), allowMissingColumns=True)
        .groupBy("line_no")
        .agg(
            F.collect_list("own").alias("own"),
            F.collect_list("term").alias("scarce"),
            F.first("line", ignorenulls=True).alias("line"),
        )
    )
    zipped = F.flatten(F.transform("own", lambda o: F.arrays_zip(*[o[x].alias(x) for x in parts])))
    return grouped.select("line_no", F.concat(zipped, "scarce").alias("terms"), "line")


def _blocks(names: Sequence[str], width: Column, columns: int | None, cell) -> Column:
    """The cells of all features of a grouped line in one array, made by ``cell(block, at, value)``."""
    counts = F.transform("terms", lambda t: t["tf"].cast("double"))
    found = []
    n_terms = n_lines = 0
    for block, name in enumerate(names):
        offset = width * n_terms + n_lines
        if isinstance(features[name], TermFeature):
            found.append(_term_cells(block, f"v{n_terms}", offset, width, columns, cell))
            n_terms += 1
        else:
            found.append(F.array(cell(block, offset, features[name].of_array(counts))))
            n_lines += 1
    return F.concat(*found)


def _term_cells(block: int, value: str, offset: Column, width: Column, columns: int | None, cell) -> Column:
    own = lambda t: cell(block, t["at"] + offset, t[value])
    if columns is None:
        return F.transform("terms", own)
    rest = F.filter("terms", lambda t: t["at"] >= columns)
    total = F.aggregate(F.array_sort(F.transform(rest, lambda t: t[value])), F.lit(0.0), lambda a, v: a + v)
    return F.concat(
        F.transform(F.filter("terms", lambda t: t["at"] < columns), own),
        F.array(cell(block, offset + width - 1, total)),
    )


def feature_cells(lines: DataFrame, weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """(line_no, block, idx, value): the chosen features side by side, in list order.

    ``idx`` counts through all blocks: a term feature is as wide as the vocabulary, a line feature
    is one column. ``weights`` is a stored table, so reading its size for the offsets is cheap. Terms are
    only brought together by line if a line feature needs it.
    """
    size = weights.agg(F.count("*")).scalar()
    cell = lambda block, at, value: F.struct(F.lit(block).alias("block"), at.alias("idx"), value.alias("value"))
    if all(isinstance(features[n], TermFeature) for n in names):
        known = known_terms(lines, weights).withColumn("width", size)
        cells = [cell(i, F.col("idx") + F.col("width") * i, features[n].value()) for i, n in enumerate(names)]
        return known.select("line_no", F.inline(F.array(*cells)))
    slim = lines.select("line_no", "tokens")
    grouped = _grouped_terms(slim, weights, names, F.col("idx"), (), slim).withColumn("width", size)
    return grouped.select("line_no", F.inline(_blocks(names, F.col("width"), None, cell)))


def line_cells(
    lines: DataFrame,
    weights: DataFrame,
    names: Sequence[str],
    width: Column,
    columns: int | None = None,
    by: Sequence[str] = (),
    texts: DataFrame | None = None,
) -> DataFrame:
    """(line_no, by..., other columns, cells): the non-zero cells of each line, sorted, in one array.

    ``cells`` holds (at, value). ``width`` is the number of columns of a term feature. With ``columns``,
    tokens stand at ``col``, and those without one are summed up in the last column of the block. ``by``
    are columns of ``lines`` and ``weights``: with several training sets, ``texts`` has each line once and a
    term finds all its sets in one join.
    """
    others = [c for c in lines.columns if c not in ("line_no", "tokens", *by)]
    place = F.col("idx") if columns is None else F.coalesce("col", F.lit(columns))
    grouped = _grouped_terms(lines, weights, names, place, by, lines if texts is None else texts)
    cell = lambda _, at, value: F.struct(at.cast("int").alias("at"), value.alias("value"))
    found = F.filter(_blocks(names, width, columns, cell), lambda c: c["value"] != 0)
    return grouped.select(
        "line_no", *by, *[F.col("line")[c].alias(c) for c in others], F.array_sort(found).alias("cells")
    )


def scale_to_unit_range(cells: DataFrame, n_cells: Column) -> DataFrame:
    """All cells of the matrix scaled to [-1, 1] by the global minimum and maximum.

    ``n_cells`` is lines times columns. Cells missing from the long table are zeros: they count
    for the minimum and maximum, and ``background`` is what each of them scales to. A constant
    matrix gives NULL.
    """
    bounds = cells.agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")
    )
    bounds = bounds.select(
        F.when(F.col("n") < n_cells, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"),
        F.when(F.col("n") < n_cells, F.greatest("high", F.lit(0.0)))
        .otherwise(F.col("high"))
        .alias("high"),
    )
    bounds = bounds.select(F.struct("low", "high")).scalar()

    def scaled(value: Column) -> Column:
        width = F.col("bounds.high") - F.col("bounds.low")
        return F.try_divide(2 * (value - F.col("bounds.low")), width) - 1

    return cells.withColumn("bounds", bounds).select(
        "line_no",
        "idx",
        scaled(F.col("value")).alias("value"),
        scaled(F.lit(0.0)).alias("background"),
    )


def dedup_messages(corpus: DataFrame, y: str = "y") -> DataFrame:
    """One row per different message, in message order, with the label of its first line."""
    return (
        corpus.groupBy("message")
        .agg(F.min_by(y, "line_no").alias(y))
        .orderBy("message")
    )
