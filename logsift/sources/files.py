"""Log files and corpora: latin-1 text in and out, and the Parquet form used between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.operators.labels import encode_labels
from logsift.operators.preprocess import CORPUS, parse_corpus, positional_join
from logsift.sources.scratch import materialize

LATIN_1 = "ISO-8859-1"

# The two files of a labeled log directory.
TRUTH_FILE = "groundtruth.seq"
LOG_FILE = "rawlog.log"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw): every line of a file, or of all files of a folder in name order.

    The scan is landed as Parquet together with each line's place in its file split, because a
    split tells its lines' order but not how many lines come before it. The splits are then counted
    and summed up; the lines themselves are neither sorted nor shuffled.
    """
    raw = F.decode(F.col("value").cast("binary"), LATIN_1)
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        raw.alias("raw"),
    )
    landed = materialize(scan, "lines")
    splits = landed.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq")
    )
    in_file = Window.partitionBy("file").orderBy("block")
    files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    file_starts = (
        splits.groupBy("file")
        .agg(F.sum("n").alias("file_n"))
        .select("file", F.coalesce(F.sum("file_n").over(files), F.lit(0)).alias("file_start"))
    )
    lower = F.sum("n").over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        splits.withColumn("lower", F.coalesce(lower, F.lit(0)))
        .join(file_starts, "file")
        .select(
            "file",
            "block",
            (F.col("file_start") + F.col("lower") - F.col("first_seq")).alias("shift"),
        )
    )
    starts = materialize(starts, "split-starts")
    return landed.join(starts, ["file", "block"]).select(
        (F.col("seq") + F.col("shift")).alias("line_no"), "raw"
    )


def read_paired_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line_no, label, raw): line i of the label file with line i of the log file."""
    folder = folder.rstrip("/")
    truth = read_log_lines(spark, f"{folder}/{TRUTH_FILE}").withColumnRenamed("raw", "label")
    return positional_join(truth, read_log_lines(spark, f"{folder}/{LOG_FILE}"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """The corpus as Parquet; keeps ``line_no``."""
    corpus.select(*CORPUS).write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_log_lines(lines: DataFrame, path: str, column: str = "raw") -> None:
    """``(line_no, raw)`` as latin-1 lines, in line order across the part files."""
    (
        lines.repartitionByRange("line_no")
        .sortWithinPartitions("line_no")
        .select(F.encode(column, LATIN_1).cast("string").alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def write_paired_lines(truth: DataFrame, raw: DataFrame, folder: str) -> None:
    """Labels ``(line_no, label)`` and raw lines ``(line_no, raw)`` as the two files of a log folder."""
    folder = folder.rstrip("/")
    write_log_lines(truth, f"{folder}/{TRUTH_FILE}", "label")
    write_log_lines(raw, f"{folder}/{LOG_FILE}")


def write_corpus_text(corpus: DataFrame, path: str) -> None:
    """The corpus as latin-1 lines ``label message``, in line order across the part files."""
    line = F.concat_ws(" ", "label", "message")
    write_log_lines(corpus.select("line_no", line.alias("raw")), path)


def read_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, label, message) from a text corpus; blank lines are dropped."""
    return parse_corpus(read_log_lines(spark, path).withColumnRenamed("raw", "value"))


def load_logs(
    spark: SparkSession,
    path: str,
    healthy: str,
    ignore_healthy: bool = False,
    text: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """A stored corpus with class ids ``y``, and its class table."""
    corpus = read_corpus_text(spark, path) if text else read_corpus(spark, path)
    return encode_labels(corpus, healthy, ignore_healthy)
