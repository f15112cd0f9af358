"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of ``bytes.split``; written for Java and RE2 patterns.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`").alias(name)


def held(names: list[str]) -> Column:
    """The named columns as one struct; a struct of nothing has a placeholder."""
    return F.struct(*[quoted(name) for name in names]) if names else F.struct(F.lit(0).alias("_"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text, remainder 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(text: Column) -> Column:
    """Tells apart different texts under one id; rows equal in both give equal results anyway."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def released(run):
    """The batch function, which hands unused memory back to the system when its task is done.

    A Python worker serves one task after the other, and what a task has freed would count on for all
    later ones: Arrow's pool and the C library keep freed blocks for themselves.
    """

    @wraps(run)
    def run_and_release(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return run_and_release


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes in the jobs that run inside the block."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def blobs(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column one after another; null is empty."""
    for value in column:
        yield value.as_py() or b""


def arrow_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [
        columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic regression by damped Newton steps.

    The targets are pulled in by one pseudo-count per class, so separable data stay finite. Without
    any row the score is 1/2; with rows of one class only, the slope is 0.
    """
    if not len(x):
        return 0.0, 0.0
    n1 = float(y.sum())
    n0 = len(y) - n1
    prior = math.log((n1 + 1) / (n0 + 1))
    spread = float(np.std(x))
    if not n0 or not n1 or not spread:
        return 0.0, prior
    z = (x - x.mean()) / spread
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, prior
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * z * z).sum() + 1e-9, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a / spread), float(b - a * x.mean() / spread)
