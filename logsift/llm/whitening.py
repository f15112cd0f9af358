"""Embedding whitening with MLlib's distributed block matrices.

Vectors become whole numbers, so sums, means and deviations are exact. Rows are numbered, centred and put
into blocks of a tall matrix X. ``X^T X`` is the scatter matrix; its eigenvectors are found locally (they
depend on the dimension only), and X times the whitening matrix projects the rows.

Three things keep the products spread over the cluster. MLlib deals the blocks of a product to the square
root of the partitions when its grid has one column, and holds what one partition gets in memory:

* The scatter is cut along the rows, ``multiply(..., splits)``, so that a task gets one pair of blocks, and
  the left side carries the number of one of a few groups as its block column, so that no single task
  adds up all partial scatters.
* For the projection the blocks of X are laid out as a square grid, and the whitening matrix stands on
  the diagonal of a matrix of as many blocks. The product has the same square grid.

Blocks are stored in the shared folder and read back as matrices, which also cuts the lineage.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from logsift.sources.scratch import materialize, scratch_path

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Whole numbers are held within this: doubles are not exact beyond.
LIMIT = 1 << 52
HALF = 26  # bits; sums are taken over the two halves of a number
LONG_MAX = (1 << 63) - 1
#: Numbers in a block: at least, at most, and what makes this many blocks in between.
LEAST_CELLS, MOST_CELLS, BLOCKS = 1 << 16, 1 << 21, 4096
GROUPS = 16
#: Eigenvalues below this share of the largest one, times the dimension, are rounding.
RANK_TOLERANCE = 1e-14

EXACT = "decimal(38,0)"
PLAIN = "m struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"


def integer_rows(df: DataFrame, vec_col: str, keep: list[str], scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(row, x): the kept columns as one struct, and ``floor(scale * component) + shift``.

    Rows whose vector is null or has a null or non-finite component are left out.
    """
    vec = F.col("__vec")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    quoted = [F.col(f"`{name.replace('`', '``')}`").alias(name) for name in (*keep, vec_col)]
    slim = df.select(F.struct(*quoted[:-1]).alias("row"), quoted[-1].cast("array<double>").alias("__vec"))
    return slim.filter(vec.isNotNull() & finite).select(
        "row", F.transform(vec, lambda c: F.floor(held(c)) + shift).alias("x")
    )


def column_sums(rows: DataFrame, length: int) -> list[int]:
    """The exact sum of every dimension, as Python integers."""
    cells = rows.select(F.posexplode("x").alias("at", "c"))
    low = F.col("c").bitwiseAND(F.lit((1 << HALF) - 1))
    sums = cells.groupBy("at").agg(F.sum(F.shiftright("c", HALF)).alias("high"), F.sum(low).alias("low"))
    found = {r["at"]: (r["high"] << HALF) + r["low"] for r in sums.collect()}  # one row per dimension
    return [found.get(at, 0) for at in range(length)]


def _deviations(n: int, sums: list[int]):
    """What turns x into the array n * x - sum: in longs, null where they do not fit, and exactly."""
    fits = F.lit([s if abs(s) <= LONG_MAX else None for s in sums]) if sums else F.array().cast("array<bigint>")
    exact = F.array(*[F.lit(Decimal(s)).cast(EXACT) for s in sums]).cast(f"array<{EXACT}>")
    fits = fits.cast("array<bigint>")
    short = lambda x: F.zip_with(x, fits, lambda c, s: F.try_subtract(F.try_multiply(F.lit(n).cast("bigint"), c), s))
    long_ = lambda x: F.zip_with(
        x, exact, lambda c, s: F.try_subtract(F.try_multiply(F.lit(n).cast("decimal(19,0)"), c.cast("decimal(19,0)")), s).cast(EXACT)
    )
    return short, long_


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """The exact sum of (n * x - sum)^2 as decimal(38,0); null if that has more digits."""
    short, long_ = _deviations(n, sums)
    add = lambda kind: lambda total, d: F.try_add(total, F.try_multiply(d, d)).cast(kind)
    fast = F.aggregate(short(x), F.lit(0).cast("bigint"), add("bigint"))
    slow = F.aggregate(long_(x), F.lit(0).cast(EXACT), add(EXACT))
    return F.coalesce(fast.cast(EXACT), slow)


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """x minus the mean as doubles, from whole numbers where they fit."""
    short, _ = _deviations(n, sums)
    means = F.lit([float(Decimal(s) / n) for s in sums]) if sums else F.array().cast("array<double>")
    exact = F.transform(short(x), lambda d: d.cast("double") / F.lit(float(n)))
    rough = F.zip_with(x, means, lambda c, m: c.cast("double") - m)
    return F.zip_with(exact, rough, lambda e, r: F.coalesce(e, r))


def plain_matrix(rows: Column, columns: int, values: Column) -> Column:
    """A dense matrix as MLlib stores it, from its numbers row after row."""
    none = F.lit(None).cast("array<int>")
    return F.struct(
        F.lit(1).cast("tinyint").alias("type"),
        rows.alias("numRows"),
        F.lit(columns).alias("numCols"),
        none.alias("colPtrs"),
        none.alias("rowIndices"),
        values.alias("values"),
        F.lit(True).alias("isTransposed"),
    )


def block_rows(n: int, length: int) -> int:
    cells = min(MOST_CELLS, max(LEAST_CELLS, n * length // BLOCKS))
    return max(1, cells // max(1, length))


def stored_blocks(rows: DataFrame, n: int, sums: list[int]) -> tuple[str, int]:
    """Blocks (block, meta, m) of centred rows stored at a path, and how many there are.

    Rows are numbered by the task that landed them and their place in it, so nothing is sorted; blocks
    never mix tasks. ``meta`` holds (row, deviation) in the order of the rows of ``m``.
    """
    most = block_rows(n, len(sums))
    place = F.monotonically_increasing_id()
    landed = rows.select("row", "x", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
    landed = materialize(landed, "numbered-vectors")
    parts = landed.groupBy("part").agg(F.ceil(F.count("*") / most).alias("blocks"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("start"), "blocks")
    starts = materialize(starts, "block-starts")
    n_blocks = starts.agg(F.max(F.col("start") + F.col("blocks"))).first()[0]
    grouped = (
        landed.join(starts, F.col("part") == F.col("of"))
        .groupBy((F.col("start") + F.floor(F.col("pos") / most)).cast("bigint").alias("block"))
        .agg(F.collect_list(F.struct("row", "x")).alias("rows"))
    )
    values = F.flatten(F.transform("rows", lambda r: centred(r["x"], n, sums)))
    matrix = plain_matrix(F.size("rows"), len(sums), values)
    meta = F.transform("rows", lambda r: F.struct(r["row"].alias("row"), deviation(r["x"], n, sums).alias("deviation")))
    path = scratch_path(rows.sparkSession, "centred-blocks")
    big_rows = {f"parquet.{what}.size.row.check.min": 1 for what in ("page", "block")}
    grouped.select("block", meta.alias("meta"), matrix.alias("m")).write.options(**big_rows).parquet(path)
    return path, n_blocks


def block_matrix(spark: SparkSession, path: str, i, j, rows: int, columns: int, shape) -> BlockMatrix:
    """The stored matrices as a block matrix with block (i, j) computed from ``block``."""
    schema = StructType([*StructType.fromDDL("block bigint"), StructField("m", MatrixUDT())])
    stored = spark.read.schema(schema).parquet(path)
    blocks = stored.select(F.struct(i.alias("i"), j.alias("j")).alias("at"), "m")
    made = callMLlibFunc("createBlockMatrix", blocks, rows, columns, int(shape[0]), int(shape[1]))
    return BlockMatrix(made, rows, columns)


def scatter(spark: SparkSession, path: str, n_blocks: int, most: int, length: int) -> np.ndarray:
    """X^T X of the stored blocks."""
    at, groups = F.col("block"), max(1, min(GROUPS, n_blocks, (1 << 24) // length**2))
    tall = block_matrix(spark, path, at, F.lit(0).cast("bigint"), most, length, (n_blocks * most, length))
    dealt = block_matrix(spark, path, at, at % groups, most, length, (n_blocks * most, groups * length))
    splits = math.ceil(n_blocks / groups)
    while math.gcd(splits, groups) > 1:  # then (block mod groups, block mod splits) are all different
        splits += 1
    left, right = dealt.transpose(), tall
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    partial = BlockMatrix(product, length, length).toLocalMatrix().toArray()
    whole = partial.reshape(groups, length, length).sum(axis=0)
    return (whole + whole.T) / 2


def projected(spark: SparkSession, path: str, n_blocks: int, most: int, whitener: np.ndarray) -> DataFrame:
    """(block, rows, values): X times the whitener, the numbers of a block column after column."""
    length, width = whitener.shape
    side = math.isqrt(n_blocks - 1) + 1
    i, j = F.floor(F.col("block") / side).cast("bigint"), F.col("block") % side
    grid = block_matrix(spark, path, i, j, most, length, (side * most, side * length))
    diagonal = scratch_path(spark, "whiteners")
    one = plain_matrix(F.lit(length), width, F.lit(whitener.ravel().tolist()))
    spark.range(side).select(F.col("id").alias("block"), one.alias("m")).write.parquet(diagonal)
    right = block_matrix(spark, diagonal, F.col("block"), F.col("block"), length, width, (side * length, side * width))
    product = grid.multiply(right)
    out = scratch_path(spark, "projected-blocks")
    blocks = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    names = blocks.columns
    blocks.select(F.col(names[0]).alias("at"), F.col(names[1]).alias("m")).write.parquet(out)
    found = spark.read.schema(StructType.fromDDL("at struct<_1:int,_2:int>, " + PLAIN)).parquet(out)
    return found.select(
        (F.col("at._1").cast("bigint") * side + F.col("at._2")).alias("block"),
        F.col("m.numRows").alias("n_rows"),
        F.col("m.values").alias("values"),
    )


def whitener_of(scatter_: np.ndarray, n: int, components: int) -> tuple[np.ndarray, list[float], list[float | None]]:
    """Whitening matrix, shares of the variance, and standard deviations (null for no direction)."""
    found, vectors = np.linalg.eigh(scatter_ / n)
    order = np.argsort(-found, kind="stable")[:components]
    top, trace = max(float(found.max()), 0.0), float(np.trace(scatter_ / n))
    least = top * len(found) * RANK_TOLERANCE
    deviations = [math.sqrt(found[c]) if found[c] > least else None for c in order]
    shares = [float(found[c]) / trace if d else 0.0 for c, d in zip(order, deviations, strict=True)]
    scale = np.array([1 / d if d else 0.0 for d in deviations])
    return vectors[:, order] * scale, shares, deviations


def identity_error(whitened: DataFrame, used: list[int]) -> float:
    """Largest absolute entry of the covariance of the components minus the identity."""
    if not used:
        return 0.0
    entry = lambda a, b: F.abs(F.covar_pop(F.col("w")[a], F.col("w")[b]) - F.lit(float(a == b)))
    pairs = [entry(a, b) for a in used for b in used if a <= b]
    return whitened.agg(F.array_max(F.array(*pairs)).alias("error")).first().error


def whiten_length(rows: DataFrame, length: int, components: int) -> DataFrame:
    """The result of :func:`whiten` for vectors of one length, at least one row."""
    spark, n = rows.sparkSession, rows.count()
    sums, most, width = column_sums(rows, length), block_rows(n, length), min(components, length)
    path, n_blocks = stored_blocks(rows, n, sums)
    whitener, shares, deviations = whitener_of(scatter(spark, path, n_blocks, most, length), n, width)
    meta = spark.read.parquet(path).select("block", "meta")
    spots = F.sequence(F.lit(0), F.col("n_rows") - 1)
    each = F.transform(spots, lambda at: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.get("values", at + c * F.col("n_rows"))))
    found = projected(spark, path, n_blocks, most, whitener).select("block", each.alias("w")).join(meta, "block")
    found = found.select(F.inline(F.arrays_zip("meta", "w"))).select("meta.row", "meta.deviation", "w")
    found = materialize(found, "whitened")
    used = [c for c, d in enumerate(deviations) if d]
    error = identity_error(found, used)
    cells = F.array(
        *[
            F.struct(
                F.lit(c + 1).alias("component"),
                (F.col("w")[c] if c in used else F.lit(None).cast("double")).alias("whitened"),
                F.lit(shares[c]).alias("explained"),
            )
            for c in range(width)
        ]
    )
    return found.select(
        "row", F.lit(n).cast("bigint").alias("n"), "deviation", F.inline(cells), F.lit(error).alias("identity_error")
    )


RESULT = "n bigint, deviation decimal(38,0), component int, whitened double, explained double, identity_error double"


def whiten(
    df: DataFrame,
    vec_col: str = "embedding",
    keep: list[str] | None = None,
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """(row, n, deviation, component, whitened, explained, identity_error): a row per vector and component.

    ``row`` holds the columns of ``keep``. A null vector and one with a null or non-finite component are
    left out; repeated rows count as often as they stand. Vectors of different lengths are whitened by
    themselves, one after another; a table is expected to have few lengths. Empty vectors have no
    component. A component without variance has no direction: ``whitened`` is null, ``explained`` 0, and
    ``identity_error`` is over the others (0 without any). Equal eigenvalues may be numbered either way.
    Scaled components are held within 2**52; a deviation of more than 38 digits is null. An empty table
    gives no rows.
    """
    keep = ["vec_id"] if keep is None else keep
    rows = materialize(integer_rows(df, vec_col, keep, scale, shift).filter(F.size("x") > 0), "whole-vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    if not lengths:
        schema = StructType([rows.schema["row"], *StructType.fromDDL(RESULT)])
        return df.sparkSession.createDataFrame([], schema)
    tables = [whiten_length(rows.filter(F.size("x") == length), length, components) for length in lengths]
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole
