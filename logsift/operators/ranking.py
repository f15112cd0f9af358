"""Exact global ranks without a global sort.

A plain ``row_number().over(orderBy(key))`` moves every row of a class into one task. Here the
64-bit key is cut into ranges of ``2**shift`` values: rows are counted per range (combined on the
map side), the counts are summed up range by range, and only rows of one range are ever sorted
together. The summing is done in two levels of at most ``2**20`` ranges each, so no window group
grows with the size of a class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.sources.scratch import materialize

COARSE_SHIFT = 20
LINE_SHIFT = 20
HASH_SHIFT = 40  # the hash key has 60 bits, so this also leaves 2**20 ranges


def _range_offsets(rows: DataFrame, within: Sequence[str], bucket: Column) -> DataFrame:
    """(within, bucket, n, start, group_rows): ``start`` rows of the group lie in lower ranges."""
    counts = (
        rows.groupBy(*within, bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
        .withColumn("coarse", F.shiftright("bucket", COARSE_SHIFT))
    )
    group = Window.partitionBy(*within)
    lower = group.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = (
        counts.groupBy(*within, "coarse")
        .agg(F.sum("n").alias("coarse_n"))
        .select(
            *[F.col(c).alias(f"coarse_{c}") for c in within],
            F.col("coarse").alias("coarse_key"),
            F.coalesce(F.sum("coarse_n").over(lower), F.lit(0)).alias("coarse_start"),
            F.sum("coarse_n").over(group).alias("group_rows"),
        )
    )
    lower = (
        Window.partitionBy(*within, "coarse")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Null-safe, so that no null filter is pushed into one branch only: both branches then share
    # the shuffle of the counts and the rows are scanned once.
    same = F.col("coarse").eqNullSafe(F.col("coarse_key"))
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"coarse_{c}"))
    return (
        counts.withColumn("fine_start", F.coalesce(F.sum("n").over(lower), F.lit(0)))
        .join(coarse, same)
        .select(
            *within,
            "bucket",
            "n",
            (F.col("coarse_start") + F.col("fine_start")).alias("start"),
            "group_rows",
        )
    )


def global_rank(
    rows: DataFrame,
    key: str,
    tie: Sequence[str] = (),
    within: Sequence[str] = (),
    shift: int = LINE_SHIFT,
    name: str = "rank",
) -> DataFrame:
    """Add the 0-based position of each row by ``(key, *tie)``, counted per ``within`` group."""
    bucket = F.shiftright(key, shift)
    offsets = _range_offsets(rows, within, bucket).select(*within, "bucket", "start")
    place = Window.partitionBy(*within, "bucket").orderBy(key, *tie)
    return (
        rows.withColumn("bucket", bucket)
        .withColumn("place", F.row_number().over(place))
        .join(offsets, [*within, "bucket"])
        .withColumn(name, F.col("start") + F.col("place") - 1)
        .select(*rows.columns, name)
    )


def keys_at_ranks(
    rows: DataFrame,
    key: str,
    ranks: Column,
    tie: Sequence[str] = (),
    within: Sequence[str] = (),
    shift: int = LINE_SHIFT,
    few_groups: bool = False,
    facts: Column | None = None,
) -> DataFrame:
    """(within, rank, key, tie): the rows that stand at the wanted 0-based ``ranks``.

    ``ranks`` is an ``array<bigint>`` column and may use ``group_rows``, the size of the group, and
    ``facts``, a scalar subquery.
    Comparing every row with such a border row then places it below or above the rank without
    moving it. Only ranges that hold a wanted rank are sorted. ``few_groups`` states that groups
    and ranks are a handful by construction, so the wanted ranges are broadcast; otherwise they are
    written first and Spark decides by their size.
    """
    bucket = F.shiftright(key, shift)
    offsets = _range_offsets(rows, within, bucket)
    if facts is not None:
        offsets = offsets.withColumn("facts", facts)
    wanted = (
        offsets.withColumn("ranks", ranks)
        .withColumn(
            "wanted",
            F.filter(
                "ranks",
                lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")),
            ),
        )
        .where(F.size("wanted") > 0)
        .select(*within, "bucket", "start", "wanted")
    )
    wanted = F.broadcast(wanted) if few_groups else materialize(wanted, "wanted-ranges")
    place = Window.partitionBy(*within, "bucket").orderBy(key, *tie)
    return (
        rows.select(*within, key, *tie, bucket.alias("bucket"))
        .join(wanted, [*within, "bucket"])
        .withColumn("rank", F.col("start") + F.row_number().over(place) - 1)
        .where(F.array_contains("wanted", F.col("rank")))
        .select(*within, "rank", key, *tie)
    )
