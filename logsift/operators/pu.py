"""The arithmetic of positive-unlabeled learning on a given score column.

A classifier trained on "labeled or not" gives p(s=1|x). Dividing by c = p(s=1|y=1), estimated as
the mean score of held-out positives, gives p(y=1|x) (Elkan and Noto, KDD 2008).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.labels import ANOMALOUS, UNLABELED


def pu_constant(scored: DataFrame, score: str = "p1") -> DataFrame:
    """One row ``c``: the mean score of the held-out positives."""
    return scored.where("is_holdout").agg(F.avg(score).alias("c"))


def pu_score(p1: Column, c: Column) -> Column:
    """p(y=1|x); not clipped, so it can exceed 1. NULL for c = 0."""
    return F.try_divide(p1, c)


def pu_decision(p1: Column, c: Column, threshold: float = 0.5) -> Column:
    """1 where the score is strictly above the threshold, else -1.

    With c = 0 any positive score counts as infinitely large.
    """
    above = F.when(c == 0, p1 > 0).otherwise(F.try_divide(p1, c) > threshold)
    return F.when(above, ANOMALOUS).otherwise(UNLABELED)
