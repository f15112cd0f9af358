"""Class ids and the binary view of the ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.ranking import global_rank
from logsift.sources.scratch import materialize

UNLABELED = -1.0
ANOMALOUS = 1.0


def fit_classes(corpus: DataFrame, healthy: str | None) -> DataFrame:
    """(label, class_id, seen_rank): labels numbered in the order they first appear.

    The healthy label gets -1 but still takes up a number, so the ids after it skip one.
    """
    first = corpus.groupBy("label").agg(F.min("line_no").alias("first_line"))
    ranked = global_rank(first, "first_line", name="seen_rank")
    class_id = F.col("seen_rank").cast("double")
    if healthy is not None:
        class_id = F.when(F.col("label") == healthy, F.lit(UNLABELED)).otherwise(class_id)
    return ranked.select("label", class_id.alias("class_id"), "seen_rank")


def encode_labels(
    corpus: DataFrame, healthy: str, ignore_healthy: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The corpus with its class id as ``y``, and the stored class table.

    With ``ignore_healthy`` the healthy lines go first, so the ids have no gap.
    """
    if ignore_healthy:
        corpus = corpus.where(F.col("label") != healthy)
    classes = materialize(fit_classes(corpus, healthy), "classes")
    ids = classes.select("label", F.col("class_id").alias("y"))
    encoded = corpus.join(ids, "label").select(*corpus.columns, "y")
    return encoded, classes


def target_names(classes: DataFrame) -> DataFrame:
    """The anomalous labels in class-id order."""
    return classes.where(F.col("class_id") != UNLABELED).select("label", "class_id")


def binary_truth(y: Column) -> Column:
    """-1 stays -1, every class becomes 1."""
    return F.when(y == UNLABELED, UNLABELED).otherwise(ANOMALOUS)


def anomalous_only(rows: DataFrame, y: str = "y") -> DataFrame:
    return rows.where(F.col(y) != UNLABELED)


def class_balance(rows: DataFrame, y: str = "y") -> DataFrame:
    """Number of unlabeled and anomalous lines."""
    return rows.groupBy(binary_truth(F.col(y)).alias("y")).agg(F.count("*").alias("n"))
