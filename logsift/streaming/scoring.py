"""Detection on a stream of log files with saved models.

Cleaning, features and decision need no state: every micro-batch runs the batch functions and becomes
one folder of the output. A batch that is repeated after a failure replaces its folder, so every line
is scored exactly once. Its scratch tables are deleted with the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsift.functions import text as T
from logsift.plans.jobs import load_models
from logsift.sources.files import LATIN_1
from logsift.sources.scratch import materialize, scratch_scope


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, raw) of the text files that arrive in ``folder``."""
    raw = F.decode(F.col("value").cast("binary"), LATIN_1)
    return spark.readStream.text(folder).select(
        F.col("_metadata.file_path").alias("file"), raw.alias("raw")
    )


def score_lines(lines: DataFrame, path: str) -> DataFrame:
    """Cleaned lines with the detector's decision ``pred``; empty lines are dropped."""
    models = load_models(lines.sparkSession, path)
    cleaned = F.filter(F.array(T.clean_tokens(F.col("raw"))), lambda t: F.size(t) > 0)
    rows = lines.select("file", "raw", F.explode(cleaned).alias("tokens"))
    rows = rows.select("*", F.array_join("tokens", " ").alias("message"), F.monotonically_increasing_id().alias("line_no"))
    rows = materialize(rows, "stream-rows")
    scored = models["binary"].transform(models["features"].transform(rows))
    return scored.select("file", "raw", "message", "pred")


def score_stream(
    spark: SparkSession, folder: str, path: str, output: str, checkpoint: str
) -> StreamingQuery:
    """Score everything that has arrived in ``folder`` into Parquet folders ``output/batch=N``."""

    def write(lines: DataFrame, batch: int) -> None:
        with scratch_scope(spark):
            score_lines(lines, path).write.mode("overwrite").parquet(f"{output}/batch={batch}")

    return (
        stream_lines(spark, folder)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
