"""The features as MLlib vectors: fit on training lines, reuse on any others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from logsift.operators.features import TermFeature, feature_cells, line_cells
from logsift.operators.vocabulary import fit_weights, repeats
from logsift.registry import features
from logsift.sources.scratch import materialize, scratch_path
from logsift.sources.stores import load_run, save_run

DEFAULT_FEATURES = ("tfilf",)
REST = "REST"
#: How a sparse vector is stored; MLlib's vector type reads the same files.
PLAIN_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


class FeatureExtractor(Estimator):
    """Builds the vocabulary and weights of ``(line_no, tokens)``.

    ``columns`` bounds the width of the vectors for models that spend memory on every column, such as
    trees: each term feature then has a column for so many tokens, those in most lines, and one more,
    REST, with the sum over all others. Without it every token has its column.
    """

    def __init__(self, names: Sequence[str] = DEFAULT_FEATURES, columns: int | None = None):
        super().__init__()
        self.names = tuple(names)
        self.columns = columns

    def _fit(self, lines: DataFrame) -> FeatureModel:
        weights = fit_weights(lines)
        if self.columns is not None:
            weights = materialize(choose_columns(weights, self.columns), "weights")
        return FeatureModel(weights, self.names, self.columns)


def choose_columns(weights: DataFrame, columns: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``col``: the place of a token among the ``columns`` most frequent ones, null for all others.

    Frequent is in most lines; ties go to the token seen first. Each task passes on ``columns`` rows at
    most, so the ranking never moves a vocabulary.
    """
    if columns < 1:
        raise ValueError(f"need at least one column, not {columns}")
    order = Window.partitionBy(*by).orderBy(F.desc("df"), "idx")
    chosen = (
        weights.select(*by, "token", "df", "idx")
        .withColumn("col", F.row_number().over(order) - 1)
        .where(F.col("col") < columns)
        .select(*by, "token", "col")
    )
    return weights.join(materialize(chosen, "columns"), [*by, "token"], "left")


class FeatureModel(Model):
    """A stored weights table and the list of features to make from it."""

    def __init__(self, weights: DataFrame, names: Sequence[str] = DEFAULT_FEATURES, columns: int | None = None):
        super().__init__()
        self.weights = weights
        self.names = tuple(names)
        self.columns = columns
        for name in self.names:
            features[name]  # an unknown name fails here

    @cached_property
    def vocabulary_size(self) -> int:
        return self.weights.count()

    def cells(self, lines: DataFrame) -> DataFrame:
        """Long form: (line_no, block, idx, value), with all tokens."""
        return feature_cells(lines, self.weights, self.names)

    @property
    def block_width(self) -> int:
        """Columns of a term feature."""
        return block_width(self.vocabulary_size, self.columns)

    @property
    def width(self) -> int:
        """Columns of the feature matrix; MLlib indexes them by 32-bit integers."""
        return matrix_width(self.names, self.block_width)

    def _transform(self, lines: DataFrame) -> DataFrame:
        """``lines``, without their tokens, and their sparse vectors."""
        if self.vocabulary_size == 0:
            raise ValueError("the vocabulary is empty")

        def vectors(rows: DataFrame) -> DataFrame:
            cells = line_cells(rows, self.weights, self.names, F.lit(self.block_width), self.columns)
            return _stored_vectors(cells, F.lit(self.width))

        return _by_text(lines, vectors)

    def feature_names(self) -> DataFrame:
        """(idx, name) of every column: the token, LENGTH for a line feature, or REST.

        With several term blocks the name is ``block:token``.
        """
        terms = [n for n in self.names if isinstance(features[n], TermFeature)]
        offset, parts = 0, []
        spark = self.weights.sparkSession
        place = F.col("idx" if self.columns is None else "col")
        one = lambda idx, name: spark.range(idx, idx + 1).select(F.col("id").alias("idx"), F.lit(name).alias("name"))
        for name in self.names:
            if name in terms:
                block = f"{name}:" if len(terms) > 1 else ""
                known = self.weights.where(place.isNotNull())
                parts.append(known.select((place + offset).cast("bigint").alias("idx"), F.concat(F.lit(block), "token").alias("name")))
                offset += self.block_width
                if self.columns is not None:
                    parts.append(one(offset - 1, block + REST))
            else:
                parts.append(one(offset, name.upper()))
                offset += 1
        names = parts[0]
        for part in parts[1:]:
            names = names.unionByName(part)
        return names

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        settings = {"features": self.names, "columns": self.columns}
        save_run(self.weights.sparkSession, settings, f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        settings = load_run(spark, f"{path}/settings")
        return cls(spark.read.parquet(f"{path}/weights"), settings["features"], settings.get("columns"))


def block_width(vocabulary_size: int, columns: int | None) -> int:
    return vocabulary_size if columns is None else min(vocabulary_size, columns) + 1


def matrix_width(names: Sequence[str], width):
    terms = sum(isinstance(features[n], TermFeature) for n in names)
    return width * terms + len(names) - terms


def _stored_vectors(cells: DataFrame, width: Column, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., ..., cells)`` with the cells as sparse vectors.

    No expression makes a vector of indices and values, so its parts are stored and read as MLlib's
    vector type.
    """
    others = [f for f in cells.schema.fields if f.name != "cells"]
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),  # sparse
        width.cast("int").alias("size"),
        F.col("cells.at").alias("indices"),
        F.col("cells.value").alias("values"),
    )
    rows = cells.select(*[f.name for f in others], vector.alias("features"))
    path = scratch_path(cells.sparkSession, "vectors")
    rows.write.partitionBy(*by).parquet(path) if by else rows.write.parquet(path)
    schema = StructType([*others, StructField("features", VectorUDT())])
    return cells.sparkSession.read.schema(schema).parquet(path)


def _by_text(lines: DataFrame, vectors) -> DataFrame:
    """``vectors(lines)``, made of each different text once if texts repeat themselves.

    Equal texts have equal vectors. The lines are then stored with the first line of their text and meet its
    vector when they are read: a few texts are broadcast by Spark's own threshold, many take a shuffle join.
    """
    if not repeats(lines):
        return vectors(lines)
    others = [c for c in lines.columns if c != "tokens"]
    texts = materialize(lines.groupBy("tokens").agg(F.min("line_no").alias("text_line")), "texts")
    of_texts = vectors(texts.withColumnRenamed("text_line", "line_no")).withColumnRenamed("line_no", "text_line")
    same = lines["tokens"].eqNullSafe(texts["tokens"])
    known = lines.join(texts, same).select(*[lines[c] for c in others], texts["text_line"])
    return materialize(known, "lines").join(of_texts, "text_line").drop("text_line")


def vector_cells(vectors: DataFrame, *keep: str, column: str = "features") -> DataFrame:
    """(keep..., idx, value): the non-zero cells of vectors, unfolded by the tasks; none becomes dense."""
    return vectors.select(*keep, unfolded(F.unwrap_udt(column)))


def unfolded(vector: Column) -> Column:
    """Rows (idx, value) of the non-zero cells of a vector read as its parts, sparse or dense."""
    sparse = F.arrays_zip(vector["indices"].alias("idx"), vector["values"].alias("value"))
    dense = F.transform(vector["values"], lambda v, i: F.struct(i.alias("idx"), v.alias("value")))
    cells = F.when(vector["type"] == 0, sparse).otherwise(dense)
    return F.inline(F.filter(cells, lambda c: c["value"] != 0))


def split_model(split_weights: DataFrame, split: int, names: Sequence[str], columns: int | None = None) -> FeatureModel:
    """The feature model of one training set out of ``fit_split_weights``."""
    mine = split_weights.where(F.col("split") == split).drop("split")
    return FeatureModel(materialize(mine, "weights", keep=True), names, columns)


def split_vectors(
    lines: DataFrame, split_weights: DataFrame, k: int, names: Sequence[str], columns: int | None = None
) -> DataFrame:
    """(split, line..., features): every line by the weights of each of the ``k`` training sets.

    One join and one grouping make the vectors of all folds; their files are divided by ``split``.
    """
    for name in names:
        features[name]
    counts = split_weights.groupBy("split").agg(F.struct("split", F.count("*").alias("n")).alias("entry"))
    sizes = counts.agg(F.map_from_entries(F.collect_list("entry"))).first()[0]  # one entry per training set
    if set(sizes) != set(range(k)):
        raise ValueError("the vocabulary of a training set is empty")
    widths = F.array(*[F.lit(block_width(sizes[split], columns)) for split in range(k)])
    width = F.get(widths, F.col("split"))
    every = F.array(*[F.lit(split) for split in range(k)])

    def vectors(rows: DataFrame) -> DataFrame:
        each = rows.withColumn("split", F.explode(every))
        cells = line_cells(each, split_weights, names, width, columns, ["split"], rows)
        return _stored_vectors(cells, matrix_width(names, width), ["split"])

    return _by_text(lines, vectors)
