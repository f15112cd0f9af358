"""Anomaly detectors and the anomaly classifier on MLlib vectors.

All estimators take ``(line_no, y, features)`` and their models add ``pred``. Detectors use -1 for
unlabeled and 1 for anomalous, the classifier uses the class ids as they are.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.models.features import PLAIN_VECTOR, unfolded
from logsift.operators.labels import ANOMALOUS, UNLABELED
from logsift.operators.pu import pu_constant, pu_decision, pu_score
from logsift.operators.splits import holdout_split
from logsift.registry import binary_models, multi_models, saved_models
from logsift.sources.scratch import scratch_path
from logsift.sources.stores import load_run, save_run


ROWS_PER_TASK = 50_000


def training_rows(rows: DataFrame, n_rows: int, *columns: str) -> DataFrame:
    """Rows in a reproducible layout: MLlib's bootstrap depends on partitions and their order.

    Hashing a unique line number spreads any class evenly. The number of tasks follows from the data
    alone, so a session's settings never change a model, and a task's rows are bounded.
    """
    return (
        rows.select("line_no", "y", "features", *columns)
        .repartition(max(1, math.ceil(n_rows / ROWS_PER_TASK)), "line_no")
        .sortWithinPartitions("line_no")
        .withColumn("label", F.when(F.col("y") == ANOMALOUS, 1.0).otherwise(0.0))
    )


def counted_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """Equal rows once: ``weight`` says how often they come, ``line_no`` is their first line.

    Cleaned log lines repeat themselves, so a learner whose loss is a sum over rows has far fewer of them to
    pass over, at the cost of one grouping that is combined on the map side.
    """
    return rows.groupBy("y", "features", *columns).agg(
        F.min("line_no").alias("line_no"), F.count("*").cast("double").alias("weight")
    )


def _load_stage(spark: SparkSession, path: str):
    return DefaultParamsReader.loadParamsInstance(path, spark)


def _probability_one(model, rows: DataFrame) -> DataFrame:
    """``p1``, the probability of class 1, or the prediction of a regression on the 0/1 labels."""
    scored = model.transform(rows)
    known = "probability" in scored.columns
    p1 = vector_to_array("probability")[1] if known else F.col("prediction")
    return scored.withColumn("p1", p1).drop("rawPrediction", "probability", "prediction")


def _sees_all_rows(base) -> bool:
    """Whether every tree is grown from all rows, so that equal ones may be one weighted row.

    A bootstrap draws each row by itself, and a least number of rows per node counts them without weights.
    """
    asked = {p.name: base.getOrDefault(p) for p in base.params if base.hasDefault(p) or base.isSet(p)}
    everything = asked.get("bootstrap") is False and asked.get("subsamplingRate") == 1.0
    return everything and asked.get("minInstancesPerNode") == 1 and "weightCol" not in asked


def _fit_forest(base, rows: DataFrame):
    """``base`` fitted on rows with their ``label``; equal rows only once where that is the same forest."""
    if not _sees_all_rows(base):
        return base.fit(rows)
    counted = counted_rows(rows).persist()
    try:
        few = training_rows(counted, counted.count(), "weight")
        return base.copy({base.weightCol: "weight"}).fit(few)
    finally:
        counted.unpersist()


class Detector(Estimator):
    """A plain probabilistic classifier as anomaly detector: unlabeled lines count as healthy."""

    def __init__(self, base):
        super().__init__()
        self.base = base

    def _fit(self, rows: DataFrame) -> DetectorModel:
        train = training_rows(rows, rows.count()).persist()
        try:
            return DetectorModel(_fit_forest(self.base, train))
        finally:
            train.unpersist()


class DetectorModel(Model):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def _transform(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows)
        # a regression on the 0/1 labels predicts the share of class 1; a classification the class itself
        pred = F.when(F.col("prediction") > 0.5, ANOMALOUS).otherwise(UNLABELED)
        return scored.select(*rows.columns, pred.alias("pred"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DetectorModel:
        return cls(_load_stage(spark, f"{path}/model"))


class PULearningClassifier(Estimator):
    """Positive-unlabeled learning around any probabilistic MLlib classifier.

    A share of the positives is held out; their mean score estimates how often a positive line
    carries its label, and every score is divided by that.
    """

    def __init__(self, base, hold_out_ratio: float = 0.1, threshold: float = 0.5, seed=0):
        super().__init__()
        if not 0 < hold_out_ratio < 1:
            raise ValueError(f"the hold-out ratio must lie between 0 and 1, not {hold_out_ratio}")
        self.base = base
        self.hold_out_ratio = hold_out_ratio
        self.threshold = threshold
        self.seed = seed

    def _fit(self, rows: DataFrame) -> PULearningModel:
        n_rows, n_pos = rows.agg(F.count("*"), F.count_if(F.col("y") == ANOMALOUS)).first()
        needed = math.ceil(n_pos * self.hold_out_ratio)
        if n_pos <= needed:
            raise ValueError(f"need more than {needed} positive rows, got {n_pos}")
        split = holdout_split(rows.select("line_no", "y", "features"), self.hold_out_ratio, self.seed)
        split = training_rows(split, n_rows, "is_holdout").persist()
        try:
            model = _fit_forest(self.base, split.where("NOT is_holdout"))
            c = pu_constant(_probability_one(model, split.where("is_holdout"))).first().c
        finally:
            split.unpersist()
        return PULearningModel(model, c, self.threshold)


class PULearningModel(Model):
    """Adds ``p1`` = p(s=1|x), ``score`` = p1 / c and the decision ``pred``."""

    def __init__(self, model, c: float, threshold: float = 0.5):
        super().__init__()
        self.model = model
        self.c = c
        self.threshold = threshold

    def _transform(self, rows: DataFrame) -> DataFrame:
        p1, c = F.col("p1"), F.lit(float(self.c))
        return (
            _probability_one(self.model, rows)
            .withColumn("score", pu_score(p1, c))
            .withColumn("pred", pu_decision(p1, c, self.threshold))
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        save_run(spark, {"c": self.c, "threshold": self.threshold}, f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PULearningModel:
        settings = load_run(spark, f"{path}/settings")
        return cls(_load_stage(spark, f"{path}/model"), settings["c"], settings["threshold"])


class SvmClassifier(Estimator):
    """One linear SVM per class; class ids may have gaps, so they are indexed first."""

    def __init__(self, parallelism: int = 4, **params):
        super().__init__()
        self.parallelism = parallelism
        self.svc_params = params

    def _fit(self, rows: DataFrame) -> SvmModel:
        counted = counted_rows(rows).persist()
        train = None
        try:
            n_rows, n_counted = counted.agg(F.sum("weight"), F.count("*")).first()
            train = training_rows(counted, n_counted, "weight").drop("label").persist()
            # Unit loss weight per line against 1/2 |w|^2, in MLlib's scale. The loose tolerance
            # ends the fit; the limit is only there for data that never converge.
            params = {
                "tol": 0.1,
                "maxIter": 1000,
                "regParam": 1.0 / max(n_rows or 0, 1),
                "standardization": False,
                **self.svc_params,
            }
            index = StringIndexer(
                inputCol="y", outputCol="class", stringOrderType="alphabetAsc"
            ).fit(train)
            one_vs_rest = OneVsRest(
                classifier=LinearSVC(**params),
                labelCol="class",
                weightCol="weight",
                parallelism=self.parallelism,
            )
            model = one_vs_rest.fit(index.transform(train))
        finally:
            counted.unpersist()
            if train is not None:
                train.unpersist()
        back = IndexToString(inputCol="prediction", outputCol="class_name", labels=index.labels)
        return SvmModel(PipelineModel([model, back]))


class SvmModel(Model):
    def __init__(self, stages: PipelineModel):
        super().__init__()
        self.stages = stages

    def _transform(self, rows: DataFrame) -> DataFrame:
        predicted = self.stages.transform(rows)
        return predicted.select(*rows.columns, F.col("class_name").cast("double").alias("pred"))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(class_id, idx, coef): the non-zero coefficients, unfolded by the tasks from the stored model."""
        path = scratch_path(spark, "svm", keep=True)
        self.save(path)
        return stored_coefficients(spark, path)

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SvmModel:
        return cls(PipelineModel.load(f"{path}/model"))


def stored_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, idx, coef) of an SVM saved at ``path``: its files are read as a table.

    Each class has a folder of its own with one vector; the driver only sees the class names. Cells that
    are zero are left out.
    """
    [names] = [r.labels for r in _stage(spark, path, 1).select("paramMap.labels").collect()]
    labels = spark.createDataFrame([(i, float(name)) for i, name in enumerate(names)], "place int, class_id double")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/model_([0-9]+)/data/[^/]*$", 1).cast("int")
    vectors = (
        spark.read.schema(f"coefficients {PLAIN_VECTOR}")
        .parquet(f"{path}/model/stages/0_*/model_*/data")
        .select(number.alias("place"), "coefficients")
    )
    cells = vectors.join(labels, "place").select("class_id", unfolded(F.col("coefficients")))
    return cells.withColumnRenamed("value", "coef")


def _stage(spark: SparkSession, path: str, at: int) -> DataFrame:
    return spark.read.json(f"{path}/model/stages/{at}_*/metadata")


def _forest(**params) -> RandomForestClassifier:
    # Ten bootstrapped trees; 30 is the deepest MLlib grows.
    return RandomForestClassifier(**{"numTrees": 10, "maxDepth": 30, "seed": 0, **params})


@binary_models.register("pu_learning")
def pu_learning(**params) -> PULearningClassifier:
    """Positive-unlabeled learning over an entropy forest; ``params`` go to the forest."""
    return PULearningClassifier(_forest(**{"impurity": "entropy", **params}))


@binary_models.register("pu_unpruned")
def pu_unpruned(**params) -> PULearningClassifier:
    """Positive-unlabeled learning for lines that have mostly lost their label.

    MLlib cuts a classification tree back where both leaves name the same class. If most positives are
    unlabeled, every leaf names the unlabeled class and nothing is left of the tree. A regression
    forest on the 0/1 labels has the same shares in its leaves and is not cut back; its impurity is the
    variance, half of Gini's.
    """
    return PULearningClassifier(RandomForestRegressor(**{"numTrees": 10, "maxDepth": 30, "seed": 0, **params}))


@binary_models.register("regular")
def regular(**params) -> Detector:
    """The same forest with Gini impurity and without the correction, for comparison.

    It is grown as a regression on the 0/1 labels: the variance is half of Gini's impurity, so the splits are
    the same, but trees are not cut back. A cut leaf has the share of all lines below it, and a few trees that
    count a mixed line among the anomalous ones could then outvote the others.
    """
    if "impurity" in params:
        return Detector(_forest(**params))
    columns = {"featureSubsetStrategy": "sqrt"}  # what classification forests draw
    return Detector(RandomForestRegressor(**{"numTrees": 10, "maxDepth": 30, "seed": 0, **columns, **params}))


@multi_models.register("svm")
def svm(**params) -> SvmClassifier:
    return SvmClassifier(**params)


saved_models.register("pu_learning", PULearningModel)
saved_models.register("pu_unpruned", PULearningModel)
saved_models.register("regular", DetectorModel)
saved_models.register("svm", SvmModel)
