"""Preprocessors by dataset name: a path to a corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logsift.operators.preprocess import preprocess_bgl, preprocess_paired
from logsift.registry import preprocessors
from logsift.sources.files import read_log_lines, read_paired_lines


@dataclass(frozen=True)
class Dataset:
    """How to read a raw log and turn it into a corpus, and which label means healthy."""

    read: Callable[[SparkSession, str], DataFrame]
    preprocess: Callable[[DataFrame], DataFrame]
    healthy: str

    def corpus(self, spark: SparkSession, path: str) -> DataFrame:
        return self.preprocess(self.read(spark, path))


# Dataset names and healthy labels.
preprocessors.register("bgl", Dataset(read_log_lines, preprocess_bgl, "unlabeled"))
for name in (
    "open_Apache",
    "open_bgl",
    "open_hadoop",
    "open_hdfs",
    "open_hpc",
    "open_proxifier",
    "open_zookeeper",
):
    preprocessors.register(name, Dataset(read_paired_lines, preprocess_paired, "NA"))
