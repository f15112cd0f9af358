"""Folds, exact samples and label noise.

Each split is a comparison of a row with a few border rows (see ``ranking``). Lines are never
shuffled for it, and a class that makes up most of the data is no special case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.numeric import hash_order
from logsift.operators.labels import ANOMALOUS, UNLABELED
from logsift.operators.ranking import HASH_SHIFT, global_rank, keys_at_ranks
from logsift.sources.scratch import materialize


def stratified_kfold(rows: DataFrame, k: int, y: str = "y") -> DataFrame:
    """Add ``fold``: each class is cut, in row order, into ``k`` near-equal blocks.

    The first ``n % k`` blocks of a class of ``n`` rows hold one row more.
    """
    if k < 2:
        raise ValueError(f"need at least 2 folds, not {k}")
    n = F.col("group_rows")
    short, longer = F.floor(n / k), n % k
    starts = F.array(*[short * i + F.least(F.lit(i), longer) for i in range(1, k)])
    borders = (
        keys_at_ranks(rows, "line_no", starts, within=[y])
        .groupBy(y)
        .agg(F.collect_list("line_no").alias("borders"))
    )
    borders = materialize(borders, "fold-borders")
    passed = F.size(F.filter("borders", lambda b: b <= F.col("line_no")))
    return rows.join(borders, y, "left").select(
        *rows.columns, F.when(F.col("borders").isNull(), 0).otherwise(passed).alias("fold")
    )


def train_part(rows: DataFrame, fold: int, swap: bool = False) -> DataFrame:
    """Training rows of a fold: all other folds, or the fold itself when swapped."""
    return rows.where(F.col("fold") == fold) if swap else rows.where(F.col("fold") != fold)


def test_part(rows: DataFrame, fold: int, swap: bool = False) -> DataFrame:
    return train_part(rows, fold, not swap)


def _order(seed) -> Column:
    return hash_order(seed, F.col("line_no"))


def _class_sizes(rows: DataFrame, y: str) -> Column:
    """struct<n_pos, n_unl> of the whole table, as a scalar."""
    sizes = rows.agg(
        F.count_if(F.col(y) == ANOMALOUS).alias("n_pos"),
        F.count_if(F.col(y) == UNLABELED).alias("n_unl"),
    )
    return sizes.select(F.struct("n_pos", "n_unl")).scalar()


def force_ratio(rows: DataFrame, ratio: int, seed=10, y: str = "y") -> DataFrame:
    """Exactly ``ratio`` unlabeled rows per anomalous one, chosen by hash order.

    All of the scarcer side is kept. A ratio of 0 or less returns the input.
    """
    if ratio <= 0:
        return rows
    ordered = rows.select("line_no", y, _order(seed).alias("key"))
    n_pos, n_unl, anomalous = F.col("facts.n_pos"), F.col("facts.n_unl"), F.col(y) == ANOMALOUS
    keep = F.when(
        n_pos * ratio <= n_unl, F.when(anomalous, n_pos).otherwise(n_pos * ratio)
    ).otherwise(F.when(anomalous, F.floor(n_unl / ratio)).otherwise(n_unl))
    borders = keys_at_ranks(
        ordered,
        "key",
        F.array(keep - 1),
        ("line_no",),
        [y],
        HASH_SHIFT,
        few_groups=True,
        facts=_class_sizes(rows, y),
    )
    border = F.struct("key", "line_no")
    borders = borders.agg(
        F.max(F.when(F.col(y) == ANOMALOUS, border)).alias("pos"),
        F.max(F.when(F.col(y) == UNLABELED, border)).alias("unl"),
    ).select(F.struct("pos", "unl"))
    here = F.struct(_order(seed).alias("key"), F.col("line_no"))
    return (
        rows.withColumn("borders", borders.scalar())
        .where(here <= F.when(anomalous, F.col("borders.pos")).otherwise(F.col("borders.unl")))
        .drop("borders")
    )


def shuffle_order(rows: DataFrame, seed=5) -> DataFrame:
    """Add ``place``: the position of the row in a reproducible random order."""
    keyed = rows.withColumn("key", _order(seed))
    return global_rank(keyed, "key", ("line_no",), shift=HASH_SHIFT, name="place").drop("key")


def noisy_labels(
    rows: DataFrame, levels: Sequence[int], seed=5, y: str = "y", name: str = "noisy"
) -> DataFrame:
    """Add an array with the label of the row at each noise level.

    At i percent, ``i * unlabeled // (100 - i)`` positives, or all if there are fewer, are
    relabeled as unlabeled. Each level starts from the clean labels.
    """
    if any(not 0 <= i < 100 for i in levels):
        raise ValueError("noise levels must be at least 0 and below 100 percent")
    positives = rows.where(F.col(y) == ANOMALOUS).select(
        y, "line_no", _order(seed).alias("key")
    )

    def lost(sizes: str, i: int) -> Column:
        n_unl, n_pos = F.col(f"{sizes}.n_unl"), F.col(f"{sizes}.n_pos")
        return F.least(F.floor(n_unl * i / (100 - i)), n_pos)

    borders = keys_at_ranks(
        positives,
        "key",
        F.array(*[lost("facts", i) - 1 for i in levels]),
        ("line_no",),
        [y],
        HASH_SHIFT,
        few_groups=True,
        facts=_class_sizes(rows, y),
    )
    by_rank = F.map_from_entries(
        F.collect_list(F.struct("rank", F.struct("key", "line_no").alias("border")))
    )
    here = F.struct(_order(seed).alias("key"), F.col("line_no"))

    def label_at(i: int) -> Column:
        border = F.try_element_at("borders", lost("sizes", i) - 1)
        gone = (F.col(y) == ANOMALOUS) & F.coalesce(here <= border, F.lit(False))
        return F.when(gone, F.lit(UNLABELED)).otherwise(F.col(y))

    return (
        rows.withColumn("sizes", _class_sizes(rows, y))
        .withColumn("borders", borders.agg(by_rank).scalar())
        .select(*rows.columns, F.array(*[label_at(i) for i in levels]).alias(name))
    )


def label_noise(rows: DataFrame, top: int, step: int, seed=5, y: str = "y") -> DataFrame:
    """Rows for each noise level 0, step, ... below ``top`` percent, with ``y_noisy``."""
    levels = list(range(0, top, step))
    noisy = noisy_labels(rows, levels, seed, y)
    pairs = F.arrays_zip(
        F.array(*[F.lit(i) for i in levels]).alias("percentage"), F.col("noisy").alias("y_noisy")
    )
    return noisy.select(*rows.columns, F.inline(pairs).alias("percentage", "y_noisy"))


def holdout_split(rows: DataFrame, ratio: float = 0.1, seed=0, y: str = "y") -> DataFrame:
    """Add ``is_holdout``: ``ceil(positives * ratio)`` positives chosen by hash order.

    Fails when no positive would be left to train on.
    """
    positives = rows.where(F.col(y) == ANOMALOUS).select(
        y, "line_no", _order(seed).alias("key")
    )
    n = F.col("group_rows")
    size = F.ceil(n * F.lit(float(ratio)))
    checked = F.when(
        n <= size, F.raise_error(F.lit("not enough positive rows for the hold-out"))
    ).otherwise(size)
    border = keys_at_ranks(
        positives,
        "key",
        F.array(checked.cast("bigint") - 1),
        ("line_no",),
        [y],
        HASH_SHIFT,
        few_groups=True,
    )
    border = border.agg(F.max(F.struct("key", "line_no"))).scalar()
    here = F.struct(_order(seed).alias("key"), F.col("line_no"))
    chosen = (F.col(y) == ANOMALOUS) & F.coalesce(here <= border, F.lit(False))
    return rows.withColumn("is_holdout", chosen)
