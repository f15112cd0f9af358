"""Mix sources to target weights by weighted sampling without replacement.

Every source has a budget of words. Whole epochs of the source come first: as many complete passes
as fit. What is left of the budget is filled by an Efraimidis-Spirakis sample: each document draws an
exponential key ``-ln(u) / quality`` and documents are taken in the order of their keys until the
prefix sum of their sizes reaches the budget. ``u`` follows from the document's id, so reruns agree.

A source may hold most of all rows, so its documents are never sorted together: keys are cut into
ranges, the sizes are summed per range, and only the one range in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import SPACE, held, quoted
from logsift.sources.scratch import materialize

U_BITS = 52


def words(text: Column) -> Column:
    """White-space separated words of a text; none of a null one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that follows from the id alone."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, U_BITS // 4), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << U_BITS))


def source_targets(sizes: DataFrame, weights: Column, limit: float) -> DataFrame:
    """(source, source_size, target): all words shared by weight, no target above ``limit`` sizes.

    The excess of capped sources goes to the others by weight until none is above: in ascending order
    of cap over weight the capped sources come first, and the first source that is not capped knows
    the share of one unit of weight. ``sizes`` has one row per source, so one task may order it.
    ``weights`` is an expression over ``place``, the place of the source by name, from 0, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weights.cast("double"))
        .withColumn("cap", limit * F.col("source_size"))
        .withColumn("all_words", F.sum("source_size").over(Window.partitionBy()))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    unit = (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    stepped = weighed.withColumn("unit", unit).withColumn("nth", F.row_number().over(order))
    open_ = F.when(F.col("cap") >= F.col("unit") * F.col("weight"), F.col("nth"))
    share = F.min_by("unit", open_).over(Window.partitionBy())
    return stepped.withColumn("share", share).select(
        "source",
        "source_size",
        F.least("cap", F.coalesce(F.col("share"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: list[str] | None = None,
    weights: Column | None = None,
    limit: float = 3.0,
    seed: int = 42,
    range_rows: int = 5_000,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, kept columns), one row per document.

    ``copies`` is how often the mix takes a document, ``taken`` its words with repeats. The last
    document of a budget is taken if at least half of it fits. The quality weight of a document is
    its share of different words, so repetitive text comes late in the sample. A null text has no
    words, a text without words is only taken in complete epochs; null sources are one source, last
    by name; a null id draws as the empty text. Rows with one id draw the same key and stay one row
    each. An empty table gives no rows. ``weights`` defaults to 1, 2, 3, repeating by name.
    """
    weights = (F.col("place") % 3 + 1) if weights is None else weights
    found = words(quoted(text_col))
    size = F.size("__words").cast("long")
    quality = F.greatest(F.size(F.array_distinct("__words")) / F.greatest(size, F.lit(1)), F.lit(1e-6))
    kept = held(keep or [id_col]).alias("kept")
    sized = materialize(
        docs.select(
            quoted(id_col).alias("doc_id"), quoted(source_col).alias("source"), kept, found.alias("__words")
        ).select(
            "doc_id",
            "source",
            "kept",
            size.alias("size"),
            (-F.log(uniform(F.col("doc_id"), seed)) / quality).alias("key"),
            quality.alias("quality"),
        ),
        "sized",
    )
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("quality").alias("rate")
    )
    targets = source_targets(sums.select("source", "source_size"), weights, limit)
    targets = targets.withColumnRenamed("source", "name").join(
        sums.select("source", "n", "rate"), F.col("name").eqNullSafe(F.col("source"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    budgets = materialize(
        targets.withColumn("epochs", F.coalesce(epochs, F.lit(0))).select(
            "source",
            "source_size",
            "target",
            "epochs",
            "rate",
            (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
            F.greatest(F.ceil(F.col("n") / range_rows), F.lit(1)).alias("ranges"),
        ),
        "budgets",
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    part = F.floor((1 - F.exp(-F.col("key") * F.col("rate"))) * F.col("ranges")).cast("long")
    ranged = sized.join(budgets, same(sized, budgets)).drop(budgets["source"]).withColumn("part", part)

    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        sums.withColumn("upto", F.sum("words").over(up_to))
        .filter(F.col("upto") >= F.col("rest"))
        .groupBy("source")
        .agg(
            F.min("part").alias("end_part"),
            F.min_by(F.col("upto") - F.col("words"), "part").alias("end_before"),
        )
    )
    ends = materialize(ends, "ends")
    marked = (
        ranged.join(ends, same(ranged, ends), "left")
        .drop(ends["source"])
        .withColumn("whole", F.coalesce(F.col("part") < F.col("end_part"), F.lit(False)))
    )
    at_end = F.coalesce(F.col("part") == F.col("end_part"), F.lit(False))
    in_range = (
        Window.partitionBy("source")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    middle = F.col("end_before") + F.sum("size").over(in_range) - F.col("size") / 2
    cut = (
        marked.filter(at_end)
        .withColumn("whole", (F.col("size") > 0) & (F.col("rest") > 0) & (middle <= F.col("rest")))
        .unionByName(marked.filter(~at_end))
    )
    copies = F.col("epochs") + F.col("whole").cast("long")
    return cut.withColumn("copies", copies).select(
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        "kept",
    )
