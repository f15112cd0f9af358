"""Small numeric and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smoothing in the inverse-frequency formula.
INVERSE_FREQUENCY_SMOOTHING = 0.01


def inverse_frequency(total: Column, count: Column) -> Column:
    """ln(total / (count + 0.01)); slightly negative when every line has the token."""
    return F.log(total.cast("double") / (count + F.lit(INVERSE_FREQUENCY_SMOOTHING)))


def hash_order(seed, key: Column) -> Column:
    """A reproducible pseudo-random 60-bit sort key for a row id.

    It is the first 15 hex digits of ``md5("seed|key")``, so any engine can reproduce the choice
    of rows. Ties are possible; break them by the row id.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn), and 0 where nothing was true or predicted."""
    return F.coalesce(F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn), F.lit(0.0))
