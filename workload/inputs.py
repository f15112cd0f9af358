"""Log lines, predictions and scores derived from the driver's tables.

Each input is defined twice with the same content: as a Spark DataFrame and as a DuckDB CTE.
``documents`` are real running text; ``events`` are spelled out as system log lines so that every
cleaning rule (colons, clock times, months, dotted numbers, prefixes, hex dumps) has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators.labels import encode_labels
from logsift.sources.scratch import materialize, spread

HEALTHY_SOURCE = "src0"
HEALTHY_EVENT = "view"
LINES_PER_DOC = 1_000_000  # line_no = doc_id * LINES_PER_DOC + position of the line


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- raw lines: (line_no, label, raw) -----------------------------------------------------------


def log_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return (
        spread(texts, "doc_id")
        .select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .select(
            F.when(F.col("pos") < LINES_PER_DOC, F.col("doc_id") * LINES_PER_DOC + F.col("pos"))
            .otherwise(F.raise_error(F.lit(f"a document of more than {LINES_PER_DOC} lines")))
            .alias("line_no"),
            F.col("source").alias("label"),
            "raw",
        )
    )



EVENT_LINE = """concat('RAS:', event_id, ' {{ ', {ts}, ' 10.0.', user_id, '.7 KERNEL ',
    CASE {kind} WHEN 'error' THEN 'FATAL' ELSE 'INFO' END,
    ' : node:card-', user_id, ' ', {kind}, ' handler() failed [', user_id,
    '] Mayor/path <id=', event_id, '>: retry  ', props)"""

BGL_LINE = """concat(CASE WHEN event_id % 11 = 0 THEN 'x' ELSE '' END, event_id, ' ', 'R', user_id,
    '-', 'M0-N1-C', ' KERN', user_id % 3, ' ',
    CASE event_type WHEN 'error' THEN 'FATAL' WHEN 'click' THEN 'WARN'
                    WHEN 'view' THEN 'ERROR' ELSE 'INFO' END,
    ' ', {ts}, '   ', 'ddr ', {kind},
    CASE WHEN {hexed} THEN {hex} ELSE '' END,
    CASE WHEN event_id % 5 = 0 THEN ' x' ELSE ' error(s) detected on node:card rank:' END,
    user_id, ' symbol ')"""

PLAIN_KIND, PLAIN_HEXED = "event_type", "event_id % 7 = 0"
# Lines for the jobs: what a line says does not always tell what it is, and classes have names of their
# own. Most "lost" lines are errors and most "quiet" ones harmless, so the best guess is often wrong.
MASKED_EVENT_KIND = """CASE
    WHEN event_type = 'error' AND event_id % 3 = 0 OR event_type = 'signup' AND event_id % 31 = 0
        OR event_type = 'view' AND event_id % 41 = 0 THEN 'lost'
    WHEN event_type = 'view' AND event_id % 4 = 1 OR event_type = 'click' AND event_id % 61 = 1 THEN 'quiet'
    ELSE event_type END"""
MASKED_BGL_KIND = """CASE
    WHEN event_type = 'error' AND event_id % 3 = 0 OR event_type = 'purchase' AND event_id % 41 = 0 THEN 'lost'
    WHEN event_type = 'signup' AND event_id % 4 = 1 OR event_type = 'view' AND event_id % 61 = 1 THEN 'quiet'
    ELSE event_type END"""
MASKED_HEXED = """event_id % 7 = 0 AND event_type IN ('signup', 'purchase')
    OR event_id % 14 = 0 AND event_type = 'error'"""
MASKED_LABEL = """CASE event_type WHEN 'error' THEN 'storage' WHEN 'click' THEN 'network'
    WHEN 'signup' THEN 'account' WHEN 'purchase' THEN 'billing' ELSE 'healthy' END"""
MASKED_HEALTHY = "healthy"

SPARK_TS = "date_format(ts, 'MMM dd HH:mm:ss')"
DUCK_TS = "strftime(ts, '%b %d %H:%M:%S')"
SPARK_HEX = "\" x'00ff' after hex dump of the card register\""
DUCK_HEX = "' x''00ff'' after hex dump of the card register'"


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"), "event_id").selectExpr(
        "event_id AS line_no",
        "event_type AS label",
        EVENT_LINE.format(ts=SPARK_TS, kind=PLAIN_KIND) + " AS raw",
    )


def log_bgl(
    spark: SparkSession, sf_dir: str, kind: str = PLAIN_KIND, hexed: str = PLAIN_HEXED
) -> DataFrame:
    return spread(table(spark, sf_dir, "events"), "event_id").selectExpr(
        "event_id AS line_no",
        BGL_LINE.format(ts=SPARK_TS, hex=SPARK_HEX, kind=kind, hexed=hexed) + " AS raw",
    )


def masked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"), "event_id").selectExpr(
        "event_id AS line_no",
        f"{MASKED_LABEL} AS label",
        EVENT_LINE.format(ts=SPARK_TS, kind=MASKED_EVENT_KIND) + " AS raw",
    )


# -- cleaned lines: (line_no, label, tokens) ------------------------------------------------------


def clean_lines(raw: DataFrame) -> DataFrame:
    """Cleaned and tokenised lines; lines with nothing left are dropped."""
    cleaned = F.filter(F.array(T.clean_tokens(F.col("raw"))), lambda t: F.size(t) > 0)
    return raw.select("line_no", "label", F.explode(cleaned).alias("tokens"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cleaned document lines: several passes read them, the regexes run once."""
    return materialize(clean_lines(log_docs(spark, sf_dir)), "docs")


def encoded(lines: DataFrame, healthy: str) -> DataFrame:
    return encode_labels(lines, healthy)[0]


# -- predictions and scores without a model -------------------------------------------------------


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, y, pred): label 3 occurs only in the predictions."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS line_no",
        "CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS DOUBLE) AS y",
        "CAST(CASE WHEN o_orderkey % 10 = 0 THEN 3 ELSE o_orderkey % 3 END AS DOUBLE) AS pred",
    )


def binary_order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS line_no",
        "CAST(CASE o_orderstatus WHEN 'F' THEN 1 ELSE -1 END AS DOUBLE) AS y",
        "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END AS DOUBLE) AS pred",
    )


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, y, p1): toxic documents are the positives, all others unlabeled."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars")
        .join(labels, "doc_id", "left")
        .selectExpr(
            "doc_id AS line_no",
            "CAST(CASE WHEN toxic = 1 THEN 1 ELSE -1 END AS DOUBLE) AS y",
            "(n_chars % 1000) / CAST(1000 AS DOUBLE) AS p1",
        )
    )


def binary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, y): error events are the positives."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS line_no",
        "CAST(CASE event_type WHEN 'error' THEN 1 ELSE -1 END AS DOUBLE) AS y",
    )


# -- the same inputs for DuckDB ---------------------------------------------------------------------

DUCK_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
DUCK_WORD = r"[\p{L}\p{N}_]"


def duck_tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{DUCK_WS}+'), lambda t: t <> '')"


def duck_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{DUCK_WS}+|{DUCK_WS}+$', '', 'g')"


def duck_clean_tokens(text: str) -> str:
    """RE2 has no look-around, so the free colons take two passes."""
    months = "Mar|Apr|Dec|Jan|Feb|Nov|Oct|May|Jun|Jul|Aug|Sep"
    for pattern, replacement in (
        (f":({DUCK_WS})", r"\1"),
        (f"({DUCK_WS}):", r"\1"),
        (r"(\p{Nd}+\.)+\p{Nd}+", ""),
        (r"\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}", ""),
        (months, ""),
        (f":?({DUCK_WORD}+:)+", ""),
        (r"[.()<>/\-=\[\]]", " "),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return (
        f"list_filter(string_split_regex({text}, '{DUCK_WS}+'), "
        "lambda t: regexp_full_match(t, '[()A-Za-z]+'))"
    )


CTES = {
    "log_docs": f"""SELECT doc_id * {LINES_PER_DOC} + i - 1 AS line_no, source AS label, l AS raw
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "log_events": f"""SELECT event_id AS line_no, event_type AS label,
        {EVENT_LINE.format(ts=DUCK_TS, kind=PLAIN_KIND)} AS raw FROM events""",
    "log_bgl": f"""SELECT event_id AS line_no,
        {BGL_LINE.format(ts=DUCK_TS, hex=DUCK_HEX, kind=PLAIN_KIND, hexed=PLAIN_HEXED)} AS raw FROM events""",
    "masked_bgl": f"""SELECT event_id AS line_no,
        {BGL_LINE.format(ts=DUCK_TS, hex=DUCK_HEX, kind=MASKED_BGL_KIND, hexed=MASKED_HEXED)} AS raw FROM events""",
    "cleaned_masked": f"""SELECT line_no, label, array_to_string(toks, ' ') AS message FROM (
        SELECT event_id AS line_no, {MASKED_LABEL} AS label, {duck_clean_tokens(
            EVENT_LINE.format(ts=DUCK_TS, kind=MASKED_EVENT_KIND))} AS toks FROM events)
        WHERE len(toks) > 0""",
    "docs": f"""SELECT * FROM (SELECT line_no, label, {duck_clean_tokens("raw")} AS toks
        FROM log_docs) WHERE len(toks) > 0""",
    "cleaned_events": f"""SELECT * FROM (SELECT line_no, label, {duck_clean_tokens("raw")} AS toks
        FROM log_events) WHERE len(toks) > 0""",
    "classes": f"""SELECT label, CASE WHEN label = '{HEALTHY_SOURCE}' THEN -1.0::DOUBLE
            ELSE (row_number() OVER (ORDER BY min(line_no)) - 1)::DOUBLE END AS y
        FROM docs GROUP BY label""",
    "encoded": "SELECT d.line_no, d.label, d.toks, c.y FROM docs d JOIN classes c USING (label)",
    "folds": """SELECT *, ntile(3) OVER (PARTITION BY y ORDER BY line_no) - 1 AS fold
        FROM encoded""",
    "words": """SELECT line_no, unnest(toks) AS token,
        generate_subscripts(toks, 1) - 1 AS pos FROM docs""",
    "totals": "SELECT count(*) AS n_lines, max(len(toks)) AS max_len FROM docs",
    "vocab": """SELECT token, row_number() OVER (ORDER BY min((line_no, pos))) - 1 AS idx,
        count(DISTINCT line_no) AS df, count(DISTINCT pos) AS lf FROM words GROUP BY token""",
    "weights": """SELECT token, idx, df, lf, ln(n_lines / (df + 0.01::DOUBLE)) AS idf,
        ln(max_len / (lf + 0.01::DOUBLE)) AS ilf FROM vocab, totals""",
    "terms": """SELECT line_no, token, count(*) AS tf FROM words GROUP BY line_no, token""",
    "cells": """SELECT line_no, idx, tf * ilf AS value FROM terms JOIN weights USING (token)""",
    "train_words": """SELECT split, line_no, unnest(toks) AS token,
        generate_subscripts(toks, 1) - 1 AS pos
        FROM folds, (SELECT unnest(range(3)) AS split) WHERE fold <> split""",
    "train_totals": """SELECT split, count(*) AS n_lines, max(len(toks)) AS max_len
        FROM folds, (SELECT unnest(range(3)) AS split) WHERE fold <> split GROUP BY split""",
    "train_vocab": """SELECT split, token,
        row_number() OVER (PARTITION BY split ORDER BY min((line_no, pos))) - 1 AS idx,
        count(DISTINCT line_no) AS df, count(DISTINCT pos) AS lf
        FROM train_words GROUP BY split, token""",
    "train_weights": """SELECT split, token, idx, ln(max_len / (lf + 0.01::DOUBLE)) AS ilf
        FROM train_vocab JOIN train_totals USING (split)""",
    "test_words": """SELECT fold AS split, line_no, unnest(toks) AS token,
        generate_subscripts(toks, 1) - 1 AS pos FROM folds""",
    "order_preds": """SELECT o_orderkey AS line_no,
        (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::DOUBLE AS y,
        (CASE WHEN o_orderkey % 10 = 0 THEN 3 ELSE o_orderkey % 3 END)::DOUBLE AS pred
        FROM orders""",
    "binary_preds": """SELECT (CASE o_orderstatus WHEN 'F' THEN 1 ELSE -1 END)::DOUBLE AS y,
        (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END)::DOUBLE AS pred FROM orders""",
    "scored_docs": """SELECT doc_id AS line_no,
        (CASE WHEN toxic = 1 THEN 1 ELSE -1 END)::DOUBLE AS y,
        (n_chars % 1000) / 1000::DOUBLE AS p1
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "binary_events": """SELECT event_id AS line_no,
        (CASE event_type WHEN 'error' THEN 1 ELSE -1 END)::DOUBLE AS y FROM events""",
}


def with_ctes(body: str, *names: str) -> str:
    """``body`` behind the named CTEs, in the order given."""
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + body
