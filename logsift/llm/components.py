"""Connected components of a large graph of few links per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.sources.scratch import materialize


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u")
        .select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        )
        .select("e.u", F.col("e.m").alias("v"))
        .filter("u > v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; the root is the smallest node reachable.

    Large-star and small-star steps in turn; each round's links are written to the shared folder, so
    lineage stays short and a lost executor costs one round. Only sums of the links reach the driver.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = materialize(links.filter("u > v").distinct(), "links")
    state = _state(links)
    while True:
        links = materialize(_small_star(_large_star(links)), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
