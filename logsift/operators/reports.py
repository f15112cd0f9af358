"""Scores and reports over predictions ``(by..., y, pred)``.

Every report starts from the counts per (y, pred) cell, which Spark combines on the map side; all
later steps work on at most classes times classes rows. ``by`` columns (a fold, a noise level)
give one result per group in a single pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.numeric import f1
from logsift.operators.labels import ANOMALOUS
from logsift.registry import model_reports, prediction_reports


def cell_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., y, pred, n): the confusion table without its empty cells."""
    return preds.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def label_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, tp, fp, fn) for every label that is true or predicted somewhere."""
    zero = F.lit(0).cast("bigint")

    def part(label, tp, fp, fn):
        return F.struct(
            label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
        )

    y, pred, n = F.col("y"), F.col("pred"), F.col("n")
    parts = F.when(y == pred, F.array(part(y, n, zero, zero))).otherwise(
        F.array(part(y, zero, zero, n), part(pred, zero, n, zero))
    )
    return (
        cell_counts(preds, by)
        .select(*by, F.inline(parts))
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )


@prediction_reports.register("acc")
def f1_binary(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 of the anomalous class (the report is called "acc")."""
    true, found = F.col("y") == ANOMALOUS, F.col("pred") == ANOMALOUS
    return (
        preds.groupBy(*by)
        .agg(
            F.count_if(true & found).alias("tp"),
            F.count_if(~true & found).alias("fp"),
            F.count_if(true & ~found).alias("fn"),
        )
        .select(*by, f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    )


@prediction_reports.register("multi_acc")
def accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.count_if(F.col("y") == F.col("pred"))
    return preds.groupBy(*by).agg(
        F.try_divide(right.cast("double"), F.count("*")).alias("accuracy")
    )


@prediction_reports.register("macro")
def f1_macro(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the F1 of each label."""
    per_label = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return label_counts(preds, by).groupBy(*by).agg(F.avg(per_label).alias("macro"))


@prediction_reports.register("micro")
def f1_micro(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 of the summed counts of all labels."""
    pooled = f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return label_counts(preds, by).groupBy(*by).agg(pooled.alias("micro"))


@prediction_reports.register("confusion_matrix")
def confusion(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., y, pred, n) for all pairs of labels, empty cells as 0."""
    cells = cell_counts(preds, by)
    labels = cells.select(*by, F.explode(F.array("y", "pred")).alias("y")).distinct()
    if by:
        columns = labels.groupBy(*by).agg(F.collect_set("y").alias("labels"))
        pairs = labels.join(columns, list(by))
    else:
        columns = labels.agg(F.collect_set("y")).scalar()
        pairs = labels.withColumn("labels", columns)
    return (
        pairs.select(*by, "y", F.explode("labels").alias("pred"))
        .join(cells, [*by, "y", "pred"], "left")
        .select(*by, "y", "pred", F.coalesce("n", F.lit(0)).alias("n"))
    )


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """The confusion table as a matrix for display: a row per true label."""
    return confusion(preds).groupBy("y").pivot("pred").agg(F.first("n")).orderBy("y")


@model_reports.register("top_k_svm")
def top_k_terms(
    coefficients: DataFrame, names: DataFrame, k: int = 5, order: DataFrame | None = None
) -> DataFrame:
    """(label, rank, name, coef): the ``k`` largest coefficients of each class, best first.

    ``coefficients`` is (label, idx, coef), ``names`` is (idx, name). Ties go to the larger idx.
    The limit is pushed below the shuffle, so each task forwards k rows per class. With fewer than three
    classes only the one in front is reported if ``order`` gives (label, place): the other is its opposite.
    """
    if order is not None:
        classes = order.agg(F.count("*").alias("n"), F.min_by("label", "place").alias("first"))
        of = classes.select(F.struct("n", "first")).scalar()
        coefficients = coefficients.withColumn("classes", of).where(
            (F.col("classes.n") > 2) | (F.col("label") == F.col("classes.first"))
        )
    best = Window.partitionBy("label").orderBy(F.desc("coef"), F.desc("idx"))
    return (
        coefficients.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .join(names, "idx")
        .select("label", "rank", "name", "coef")
    )


def best_fold(results: DataFrame, *scores: str) -> DataFrame:
    """The one fold with the largest scores, compared in order; the first fold wins ties."""
    return results.orderBy(*[F.desc(s) for s in scores], F.asc("fold")).limit(1)


# Which task a prediction report suits: "acc" is defined for two classes only.
BINARY_REPORTS = ("acc", "multi_acc", "macro", "micro", "confusion_matrix")
MULTI_REPORTS = ("multi_acc", "macro", "micro", "confusion_matrix")


def run_reports(
    names: Sequence[str],
    binary: DataFrame | None = None,
    multi: DataFrame | None = None,
    model_inputs: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    k: int = 5,
) -> dict[tuple[str, str], DataFrame]:
    """{(task, report): DataFrame} for the reports that apply to what is given."""
    found = {}
    for name in names:
        if name in model_reports:
            if model_inputs is not None:
                coefficients, columns, order = model_inputs
                found["multi", name] = model_reports[name](coefficients, columns, k, order)
            continue
        report = prediction_reports[name]
        own = name not in BINARY_REPORTS
        if binary is not None:
            found["binary", name] = report(binary)
        if multi is not None and (own or name in MULTI_REPORTS):
            found["multi", name] = report(multi)
    return found
