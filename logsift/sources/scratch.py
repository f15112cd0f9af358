"""Intermediate tables in the cluster's shared folder.

Fitted tables (class ids, vocabularies, fold borders) are written before they are joined back to
the lines. That cuts lineage, survives a lost executor, and gives the planner a true file size: a
small table is then broadcast by Spark's own threshold, a large one falls back to a shuffle join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="logsift-"))
    return context.getCheckpointDir().rstrip("/")


#: Folders of the scopes that are open, the innermost last.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scratch_scopes", default=())


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Scratch tables made inside the block are deleted at its end, but for those that are kept.

    A kept table belongs to the scope around this one, or to nobody. Whatever leaves the block must read
    kept tables only.
    """
    folder = f"{scratch_dir(spark)}/logsift/scope-{uuid.uuid4().hex}"
    token = _SCOPES.set((*_SCOPES.get(), folder))
    try:
        yield folder
    finally:
        _SCOPES.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path for one table under the shared folder, in the open scope unless it is to be kept."""
    scopes = _SCOPES.get()[: -1 if keep else None]
    return f"{scopes[-1] if scopes else scratch_dir(spark) + '/logsift'}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Spread rows by ``key`` when the scan has fewer tasks than the cluster has cores.

    Helps files that cannot be split: one row group, one gzip member. Large inputs have more
    splits than cores and pass unchanged.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows
