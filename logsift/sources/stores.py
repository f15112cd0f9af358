"""Result tables and run configurations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_results(results: DataFrame, path: str) -> None:
    """Result rows as CSV with a header."""
    results.write.mode("overwrite").option("header", True).csv(path)


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


# One row per fold of a run: what was asked for, what came out, and how long it took.
RECORD = (
    "run_id string, job string, settings map<string,string>, fold int, best boolean, "
    "scores map<string,double>, train_time double, run_time double"
)


def append_record(record: DataFrame, path: str) -> None:
    """Add the rows of a run to the table of all runs."""
    record.coalesce(1).write.mode("append").parquet(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """All runs recorded at ``path``, typed as they were written."""
    return spark.read.schema(RECORD).parquet(path)


def setting(name: str, kind: str = "string") -> Column:
    """One setting of a record as a typed column; lists and numbers are stored as JSON."""
    value = F.col("settings")[name]
    return F.from_json(value, kind) if kind.startswith("array") else value.cast(kind)


def save_run(spark: SparkSession, config: dict, path: str) -> None:
    """The settings of a run as one JSON row."""
    row = spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def load_run(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)
