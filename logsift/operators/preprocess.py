"""Raw log lines to a corpus of ``(line_no, label, message)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators.ranking import global_rank
from logsift.sources.scratch import materialize

CORPUS = ("line_no", "label", "message")


def keep_non_empty(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name`` and drop the rows where it is empty.

    A filter on the cleaned message would be pushed below the projection and run the regex chain
    a second time; exploding a 0- or 1-element array evaluates it once.
    """
    return rows.select(
        "*", F.explode(F.filter(F.array(value), lambda m: m != "")).alias(name)
    )


def positional_join(truth: DataFrame, raw: DataFrame) -> DataFrame:
    """Line i of the labels with line i of the log; the longer side's rest is left out."""
    return truth.join(raw, "line_no", "inner")


def number_lines(rows: DataFrame, key: str) -> DataFrame:
    """Dense 0-based ``line_no`` in the order of a unique bigint ``key``."""
    return global_rank(rows, key, name="line_no")


def preprocess_paired(pairs: DataFrame) -> DataFrame:
    """Corpus from ``(line_no, label, raw)``: first word of the raw line dropped, rest cleaned."""
    rows = pairs.select("line_no", T.strip(F.col("label")).alias("label"), "raw")
    message = T.clean_parameters(T.drop_first_token(F.col("raw")))
    return keep_non_empty(rows, "message", message).select(*CORPUS)


def paired_corpus(truth: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Corpus from labels ``(line_no, label)`` and raw lines ``(key, raw)`` in the order of ``key``.

    Only keys are ranked and joined by position. The pairs are stored, so the planner knows their size:
    few labels are broadcast to the scan, and only the raw lines that have one are cleaned.
    """
    label = T.strip(F.col("label")).alias("label")
    pairs = positional_join(truth, number_lines(raw.select(key), key)).select(key, "line_no", label)
    paired = raw.select(key, "raw").join(materialize(pairs, "pairs"), key)
    message = T.clean_parameters(T.drop_first_token(F.col("raw")))
    return keep_non_empty(paired, "message", message).select(*CORPUS)


def preprocess_bgl(raw: DataFrame) -> DataFrame:
    """Corpus from BlueGene/L lines ``(line_no, raw)``.

    Kept are lines with a leading record id, a severity other than WARN and a body of more than
    20 characters. INFO lines become ``unlabeled``; others are labeled by the word in front of the
    severity. The checks that cost one regex run before the cleaning.
    """
    line = F.col("line")
    lines = raw.select(
        "line_no",
        F.explode(F.filter(F.array(T.strip(F.col("raw"))), T.bgl_has_record_id)).alias("line"),
    )
    parts = F.struct(
        T.bgl_severity(line).alias("severity"),
        T.bgl_component(line).alias("component"),
        T.bgl_body(line).alias("body"),
    )
    bodies = lines.select(
        "line_no",
        F.inline(
            F.filter(
                F.array(parts),
                lambda p: p["severity"].isin("INFO", "ERROR", "FATAL")
                & (F.length(p["body"]) > T.BGL_MIN_BODY),
            )
        ),
    ).withColumn(
        "label", F.when(F.col("severity") == "INFO", "unlabeled").otherwise(F.col("component"))
    )
    return keep_non_empty(bodies, "message", T.clean_parameters(F.col("body"))).select(*CORPUS)


def parse_corpus(lines: DataFrame) -> DataFrame:
    """Corpus from text lines ``(line_no, value)`` of the form ``label word word ...``.

    Blank lines are dropped; a line with a label only keeps an empty message.
    """
    return (
        lines.select("line_no", T.tokens(F.col("value")).alias("words"))
        .where(F.size("words") > 0)
        .select(
            "line_no",
            F.col("words")[0].alias("label"),
            T.join_from(F.col("words"), 2).alias("message"),
        )
    )
