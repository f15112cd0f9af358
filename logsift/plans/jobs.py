"""Training with cross-validation, scoring with saved models, and the label-noise sweep.

Jobs take a corpus ``(line_no, label, message)``. It is tokenised, encoded and folded once and
stored; vocabularies and weights of all folds come from one pass. Only the model fits loop over the
folds, as they must. Predictions of all folds form one table and are scored in one aggregation.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from contextvars import copy_context
from dataclasses import dataclass, field
from functools import wraps
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.models import classifiers  # noqa: F401  registers the models
from logsift.models.features import DEFAULT_FEATURES, FeatureModel, choose_columns, split_model, split_vectors
from logsift.operators import reports as R
from logsift.operators import splits as S
from logsift.operators.labels import (
    anomalous_only,
    binary_truth,
    encode_labels,
    target_names,
)
from logsift.operators.vocabulary import fit_split_weights, tokenize
from logsift.registry import binary_models, multi_models, saved_models
from logsift.sources.scratch import materialize, scratch_scope
from logsift.sources.stores import load_run, save_results, save_run

DEFAULT_FOLDS = 3


@dataclass
class Run:
    """What a job found: scores per fold, predictions, reports, and the models of the best fold."""

    results: DataFrame
    best_fold: int | None = None
    binary: DataFrame | None = None
    multi: DataFrame | None = None
    lines: DataFrame | None = None
    reports: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)

    def record(self, run_id: str, job: str, settings: dict) -> DataFrame:
        """The run as a typed table, one row per fold: settings, scores and seconds."""
        times = ("train_time", "run_time")
        kinds = dict(self.results.dtypes)
        scores = [c for c in self.results.columns if kinds[c] == "double" and c not in times]
        pairs = [x for name, value in sorted(settings.items()) for x in (F.lit(name), F.lit(_as_text(value)))]
        return self.results.select(
            F.lit(run_id).alias("run_id"),
            F.lit(job).alias("job"),
            F.create_map(*pairs).cast("map<string,string>").alias("settings"),
            F.col("fold").cast("int").alias("fold"),
            (F.col("fold") == self.best_fold).alias("best"),
            F.create_map(*[x for c in scores for x in (F.lit(c), F.col(c))]).alias("scores"),
            *[F.col(c).cast("double") if c in kinds else F.lit(None).cast("double").alias(c) for c in times],
        )

    def save(self, path: str, config: dict) -> None:
        """The best fold's models, the settings and the results under one folder."""
        for name, model in self.models.items():
            model.save(f"{path}/{name}")
        save_run(self.results.sparkSession, config, f"{path}/run")
        save_results(self.results, f"{path}/results")


def _as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def prepare(corpus: DataFrame, healthy: str) -> tuple[DataFrame, DataFrame]:
    """(line_no, y, tokens) and the class table."""
    rows, classes = encode_labels(corpus, healthy)
    classes = materialize(classes.coalesce(1), "classes", keep=True)
    return tokenize(rows.select("line_no", "y", "message")), classes


def timed(function, *args):
    start = time.time()
    return function(*args), time.time() - start


def fit_timed(estimator, rows: DataFrame):
    """The fitted model and the seconds it took."""
    return timed(estimator.fit, rows)


def predict_timed(model, rows: DataFrame, **columns):
    """Stored predictions ``(line_no, y, pred, ...)`` and the seconds it took to make them."""
    labels = [F.lit(value).alias(name) for name, value in columns.items()]
    preds = model.transform(rows).select("line_no", "y", "pred", *labels)
    return timed(materialize, preds, "predictions", True)


def _each_fold(spark: SparkSession, fit, k: int, parallelism: int) -> list:
    """``fit(fold)`` for every fold, up to ``parallelism`` at a time.

    The fits are independent Spark jobs; overlapping them fills the gaps between short stages, at
    the price of holding that many training sets.
    """
    own = [(copy_context(), fold) for fold in range(k)]  # a thread writes to the scratch scope of its job
    target = inheritable_thread_target(spark)(lambda context, fold: context.run(fit, fold))
    with ThreadPool(max(1, min(parallelism, k))) as pool:
        return pool.starmap(target, own)


def _scoped(job):
    """The job inside a scratch scope: only what it returns or saves stays."""

    @wraps(job)
    def run(corpus: DataFrame, *args, **kwargs) -> Run:
        with scratch_scope(corpus.sparkSession):
            return job(corpus, *args, **kwargs)

    return run


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def _as_binary(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", binary_truth(F.col("y")))


@dataclass
class Folds:
    """The training sets of a cross-validation and the vectors of their lines, all from one pass."""

    k: int
    swap: bool
    names: Sequence[str]
    columns: int | None
    weights: DataFrame
    vectors: DataFrame

    def train(self, fold: int) -> DataFrame:
        return S.train_part(self._of(fold), fold, self.swap)

    def test(self, fold: int) -> DataFrame:
        return S.test_part(self._of(fold), fold, self.swap)

    def _of(self, fold: int) -> DataFrame:
        return self.vectors.where(F.col("split") == fold).drop("split")

    def model(self, fold: int) -> FeatureModel:
        return split_model(self.weights, fold, self.names, self.columns)


def _fold(
    rows: DataFrame, k: int, swap: bool, names: Sequence[str], columns: int | None, only=lambda rows: rows
) -> Folds:
    """Folds of ``(line_no, y, tokens)``; vectors are only made of the lines that ``only`` keeps."""
    rows = materialize(S.stratified_kfold(rows, k), "folds")
    weights = fit_split_weights(rows, k, swap)
    if columns is not None:
        weights = materialize(choose_columns(weights, columns, ["split"]), "weights")
    return Folds(k, swap, names, columns, weights, split_vectors(only(rows), weights, k, names, columns))


def _times_table(spark: SparkSession, times: list[tuple]) -> DataFrame:
    return spark.createDataFrame(times, "fold int, train_time double, run_time double")


def _svm_inputs(model, features: FeatureModel, classes: DataFrame):
    """Coefficients by label, the column names, and the classes in the order they are first seen."""
    labels = target_names(classes)
    coefficients = model.coefficients(classes.sparkSession).join(labels, "class_id")
    order = labels.select("label", F.col("class_id").alias("place"))
    return coefficients.select("label", "idx", "coef"), features.feature_names(), order


@_scoped
def train_binary(
    corpus: DataFrame,
    healthy: str,
    k: int = DEFAULT_FOLDS,
    features: Sequence[str] = DEFAULT_FEATURES,
    columns: int | None = None,
    binary_classifier: str = "pu_learning",
    reports: Sequence[str] = ("confusion_matrix",),
    path: str | None = None,
    parallelism: int = 1,
    **params,
) -> Run:
    """Cross-validated anomaly detection; the fold with the best F1 is kept."""
    rows, _ = prepare(corpus, healthy)
    folds = _fold(rows, k, False, features, columns, _as_binary)
    spark = corpus.sparkSession

    def fit(fold):
        model, train_time = fit_timed(binary_models[binary_classifier](**params), folds.train(fold))
        found, run_time = predict_timed(model, folds.test(fold), fold=fold)
        return model, found, (fold, train_time, run_time)

    models, preds, times = zip(*_each_fold(spark, fit, k, parallelism), strict=True)
    preds = _union(preds)
    results = R.f1_binary(preds, ["fold"]).join(_times_table(spark, times), "fold")
    results = materialize(results.coalesce(1), "results", keep=True)
    best = R.best_fold(results, "f1").first().fold
    run = Run(
        results,
        best,
        binary=preds,
        reports=R.run_reports(reports, preds.where(F.col("fold") == best)),
        models={"features": folds.model(best), "binary": models[best]},
    )
    if path:
        run.save(path, {"healthy": healthy, "binary": binary_classifier, "best_fold": best})
    return run


@_scoped
def train_global(
    corpus: DataFrame,
    healthy: str,
    k: int = DEFAULT_FOLDS,
    features: Sequence[str] = DEFAULT_FEATURES,
    columns: int | None = None,
    binary_classifier: str = "pu_learning",
    multi_classifier: str = "svm",
    reports: Sequence[str] = ("confusion_matrix",),
    path: str | None = None,
    binary_params: dict | None = None,
    multi_params: dict | None = None,
    parallelism: int = 1,
) -> Run:
    """Cross-validated detection and classification; best F1 wins, then best accuracy."""
    rows, classes = prepare(corpus, healthy)
    folds = _fold(rows, k, False, features, columns)
    spark = corpus.sparkSession

    def fit(fold):
        train, test = folds.train(fold), folds.test(fold)
        detector = binary_models[binary_classifier](**(binary_params or {}))
        detector, detect_time = fit_timed(detector, _as_binary(train))
        classifier = multi_models[multi_classifier](**(multi_params or {}))
        classifier, classify_time = fit_timed(classifier, anomalous_only(train))
        detected, detect_run = predict_timed(detector, _as_binary(test), fold=fold)
        classified, classify_run = predict_timed(classifier, anomalous_only(test), fold=fold)
        seconds = (fold, detect_time + classify_time, detect_run + classify_run)
        return (detector, classifier), detected, classified, seconds

    fitted = _each_fold(spark, fit, k, parallelism)
    models, binary_preds, multi_preds, times = zip(*fitted, strict=True)
    binary_preds, multi_preds = _union(binary_preds), _union(multi_preds)
    results = (
        R.f1_binary(binary_preds, ["fold"])
        .join(R.accuracy(multi_preds, ["fold"]), "fold")
        .join(_times_table(spark, times), "fold")
    )
    results = materialize(results.coalesce(1), "results", keep=True)
    best = R.best_fold(results, "f1", "accuracy").first().fold
    detector, classifier = models[best]
    feature_model = folds.model(best)
    run = Run(
        results,
        best,
        binary=binary_preds,
        multi=multi_preds,
        reports=R.run_reports(
            reports,
            binary_preds.where(F.col("fold") == best),
            multi_preds.where(F.col("fold") == best),
            _svm_inputs(classifier, feature_model, classes),
        ),
        models={"features": feature_model, "binary": detector, "multi": classifier},
    )
    if path:
        run.save(
            path,
            {
                "healthy": healthy,
                "binary": binary_classifier,
                "multi": multi_classifier,
                "best_fold": best,
            },
        )
        classes.write.mode("overwrite").parquet(f"{path}/classes")
    return run


def load_models(spark: SparkSession, path: str) -> dict:
    """The feature model and classifiers that a training job saved."""
    config = load_run(spark, f"{path}/run")
    models = {"features": FeatureModel.load(spark, f"{path}/features")}
    for task in ("binary", "multi"):
        if task in config:
            models[task] = saved_models[config[task]].load(spark, f"{path}/{task}")
    return models


@_scoped
def score_binary(
    corpus: DataFrame,
    path: str,
    reports: Sequence[str] = ("confusion_matrix",),
) -> Run:
    """Detection with saved models, scored against the labels of the corpus."""
    spark = corpus.sparkSession
    models = load_models(spark, path)
    healthy = load_run(spark, f"{path}/run")["healthy"]
    y = F.when(F.col("label") == healthy, -1.0).otherwise(1.0)
    rows = tokenize(corpus.select("line_no", y.alias("y"), "message"))
    preds, _ = predict_timed(models["binary"], models["features"].transform(rows))
    return Run(
        R.f1_binary(preds),
        binary=preds,
        reports=R.run_reports(reports, preds),
        models=models,
    )


@_scoped
def score_global(
    corpus: DataFrame,
    path: str,
    reports: Sequence[str] = ("confusion_matrix",),
    cascade: bool = False,
) -> Run:
    """Detection, then classification, with saved models.

    Classification runs on the truly anomalous lines, or with ``cascade`` on the lines the detector
    found: those may be healthy in truth, and anomalies it missed are left out. ``lines`` of the result
    has every line: (line_no, label, class_id, anomaly, pred), ``pred`` is null where no class was asked for.
    Class ids are those of the training corpus; lines of a class it did not have keep a NULL
    class id and count as wrong.
    """
    spark = corpus.sparkSession
    models = load_models(spark, path)
    healthy = load_run(spark, f"{path}/run")["healthy"]
    classes = spark.read.parquet(f"{path}/classes")
    ids = classes.select("label", F.col("class_id").alias("class_id"))
    y = F.when(F.col("label") == healthy, -1.0).otherwise(1.0)
    rows = tokenize(
        corpus.join(ids, "label", "left").select("line_no", "label", y.alias("y"), "class_id", "message")
    )
    vectors = models["features"].transform(rows)
    detected = models["binary"].transform(vectors).withColumnRenamed("pred", "anomaly")
    detected = materialize(
        detected.select("line_no", "label", "y", "class_id", "features", "anomaly"), "detected"
    )
    chosen = F.col("anomaly" if cascade else "y") == 1.0
    columns = ("line_no", "label", "y", "class_id", "anomaly", "pred")
    classified = models["multi"].transform(detected.where(chosen)).select(*columns)
    others = detected.where(~chosen).withColumn("pred", F.lit(None).cast("double")).select(*columns)
    lines = materialize(classified.unionByName(others), "scored-lines", keep=True)
    binary = lines.select("line_no", "y", F.col("anomaly").alias("pred"))
    multi = lines.where(F.col("pred").isNotNull()).select(
        "line_no", F.coalesce("class_id", F.lit(-2.0)).alias("y"), "pred"
    )
    return Run(
        R.f1_binary(binary).withColumn("accuracy", R.accuracy(multi).scalar()),
        binary=binary,
        multi=multi,
        lines=lines.drop("y"),
        reports=R.run_reports(
            reports, binary, multi, _svm_inputs(models["multi"], models["features"], classes)
        ),
        models=models,
    )


@_scoped
def train_multi(
    corpus: DataFrame,
    healthy: str,
    k: int = DEFAULT_FOLDS,
    swap: bool = False,
    features: Sequence[str] = DEFAULT_FEATURES,
    columns: int | None = None,
    multi_classifier: str = "svm",
    path: str | None = None,
    exp_name: str = "multi",
    logs_type: str = "logs",
    parallelism: int = 1,
    **params,
) -> Run:
    """Cross-validated classification of anomalous lines; ``swap`` trains on one fold only."""
    rows, classes = prepare(corpus, healthy)
    folds = _fold(rows, k, swap, features, columns, anomalous_only)
    spark = corpus.sparkSession

    def fit(fold):
        model, train_time = fit_timed(multi_models[multi_classifier](**params), folds.train(fold))
        found, run_time = predict_timed(model, folds.test(fold), fold=fold)
        return model, found, (fold, train_time, run_time)

    models, preds, times = zip(*_each_fold(spark, fit, k, parallelism), strict=True)
    preds = _union(preds)
    results = (
        R.f1_macro(preds, ["fold"])
        .join(R.f1_micro(preds, ["fold"]), "fold")
        .join(_times_table(spark, times), "fold")
        .select(
            F.lit(exp_name).alias("exp_name"),
            F.lit(logs_type).alias("logs_type"),
            "fold",
            "macro",
            "micro",
            "train_time",
            "run_time",
        )
    )
    results = materialize(results.coalesce(1), "results", keep=True)
    best = R.best_fold(results, "macro").first().fold
    run = Run(
        results,
        best,
        multi=preds,
        models={"features": folds.model(best), "multi": models[best]},
    )
    if path:
        run.save(path, {"healthy": healthy, "multi": multi_classifier, "best_fold": best})
        classes.write.mode("overwrite").parquet(f"{path}/classes")
    return run


@_scoped
def pu_robustness(
    corpus: DataFrame,
    healthy: str,
    ratio: int = 8,
    top_percentage: int = 11,
    step: int = 1,
    k: int = DEFAULT_FOLDS,
    features: Sequence[str] = DEFAULT_FEATURES,
    columns: int | None = None,
    binary_classifier: str = "regular",
    pu_classifier: str = "pu_learning",
    path: str | None = None,
    exp_name: str = "pu_robustness",
    logs_type: str = "logs",
    parallelism: int = 1,
    **params,
) -> Run:
    """F1 of positive-unlabeled learning and of a plain classifier as labels get lost.

    For each fold and each noise percentage, some training positives are relabeled as unlabeled;
    the test labels stay clean. Where few positives keep their label, ``pu_unpruned`` is the learner whose
    trees stay whole.
    """
    rows, _ = prepare(corpus, healthy)
    rows = materialize(_as_binary(rows), "binary")
    folds = _fold(S.force_ratio(rows, ratio), k, False, features, columns)
    levels = list(range(0, top_percentage, step))
    names = {"pu_f1": pu_classifier, f"{binary_classifier}_f1": binary_classifier}

    def sweep(fold):
        train = S.noisy_labels(folds.train(fold), levels).persist()
        test = folds.test(fold).persist()
        found = []
        for at, level in enumerate(levels):
            noisy = train.withColumn("y", F.col("noisy")[at])
            for score, name in names.items():
                model = binary_models[name](**params).fit(noisy)
                columns = {"fold": fold, "percentage": level, "score": score}
                found.append(predict_timed(model, test, **columns)[0])
        train.unpersist()
        test.unpersist()
        return found

    swept = _each_fold(corpus.sparkSession, sweep, k, parallelism)
    preds = [p for found in swept for p in found]
    scores = R.f1_binary(_union(preds), ["fold", "percentage", "score"])
    results = (
        scores.groupBy("fold", "percentage")
        .pivot("score", list(names))
        .agg(F.first("f1"))
        .select(
            F.lit(exp_name).alias("exp_name"),
            F.lit(logs_type).alias("logs_type"),
            "fold",
            "percentage",
            *names,
        )
    )
    results = materialize(results.coalesce(1), "results", keep=True)
    if path:
        save_results(results, path)
    return Run(results, binary=_union(preds))
