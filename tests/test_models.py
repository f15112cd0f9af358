"""Feature vectors, models and jobs on separable synthetic lines."""

import inspect
import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from logsift.models import classifiers
from logsift.models import features as feature_models
from logsift.models.classifiers import (
    PULearningClassifier,
    PULearningModel,
    SvmModel,
    pu_learning,
    pu_unpruned,
    regular,
    svm,
)
from logsift.models.features import FeatureExtractor, FeatureModel
from logsift.operators.features import TermFeature
from logsift.operators.labels import binary_truth
from logsift.operators.vocabulary import fit_split_weights
from logsift.plans import jobs
from logsift.registry import Registry, features
from logsift.sources import stores

WORDS = {
    "ok": "service started normally and is ready",
    "disk": "disk failure sector unreadable on device",
    "net": "network link down packet lost",
}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    rows = []
    for i in range(360):
        label = rng.choices(list(WORDS), [4, 1, 1])[0]
        words = WORDS[label].split() + rng.choices("alpha beta gamma delta".split(), k=3)
        rng.shuffle(words)
        rows.append((i, label, " ".join(words)))
    return spark.createDataFrame(rows, "line_no bigint, label string, message string").cache()


@pytest.fixture(scope="module")
def vectors(spark, corpus):
    rows, _ = jobs.prepare(corpus, "ok")
    model = FeatureExtractor(["tfilf", "length"]).fit(rows)
    return model.transform(rows).cache()


def test_vectors_equal_the_long_form(spark, corpus):
    rows, _ = jobs.prepare(corpus, "ok")
    model = FeatureExtractor(["tfilf", "length", "tf", "tfidf"]).fit(rows)
    other = rows.withColumn("tokens", F.concat(F.slice("tokens", 1, 4), F.array(F.lit("new"))))
    cells = {(r.line_no, r.idx): r.value for r in model.cells(other).collect()}
    dense = (
        model.transform(other)
        .select("line_no", F.posexplode(vector_to_array("features")).alias("idx", "value"))
        .where("value != 0")
        .collect()
    )
    assert {(r.line_no, r.idx): r.value for r in dense} == pytest.approx(cells)
    names = {r.idx: r.name for r in model.feature_names().collect()}
    size = model.vocabulary_size
    assert len(names) == 3 * size + 1
    assert names[size] == "LENGTH"
    assert names[0].startswith("tfilf:")


def test_feature_model_round_trip(spark, corpus, tmp_path):
    rows, _ = jobs.prepare(corpus, "ok")
    model = FeatureExtractor(["tfidf"]).fit(rows)
    model.save(str(tmp_path / "m"))
    again = FeatureModel.load(spark, str(tmp_path / "m"))
    assert again.names == ("tfidf",)
    assert sorted(map(tuple, again.weights.collect())) == sorted(map(tuple, model.weights.collect()))


def test_pu_learning(spark, vectors, tmp_path):
    """Half of the anomalous lines lose their label; the model still finds nearly all."""
    truth = vectors.withColumn("truth", binary_truth(F.col("y")))
    lost = truth.withColumn(
        "y", F.when(F.col("line_no") % 2 == 0, F.lit(-1.0)).otherwise(F.col("truth"))
    )
    model = pu_learning().fit(lost)
    assert 0 < model.c < 1
    preds = model.transform(lost)
    right = preds.select(F.avg((F.col("pred") == F.col("truth")).cast("double"))).first()[0]
    assert right > 0.95
    model.save(str(tmp_path / "pu"))
    again = PULearningModel.load(spark, str(tmp_path / "pu")).transform(lost)
    columns = ["line_no", "p1", "score", "pred"]
    assert again.select(columns).exceptAll(preds.select(columns)).count() == 0


def test_pu_finds_lines_that_mostly_lost_their_label(spark, vectors, tmp_path):
    """One of seven anomalous lines keeps its label, so no leaf has a majority of them."""
    rows = vectors.withColumn("truth", binary_truth(F.col("y")))
    rows = rows.withColumn("y", F.when((F.col("truth") == 1) & (F.col("line_no") % 7 == 0), 1.0).otherwise(-1.0))
    right = lambda model: model.transform(rows).where("truth = pred").count() / rows.count()
    shallow = {"maxDepth": 4, "minInstancesPerNode": 10}  # deeper trees learn the lines by heart
    model = pu_unpruned(**shallow).fit(rows)
    assert right(model) > 0.95 > right(pu_learning(**shallow).fit(rows))
    model.save(str(tmp_path / "pu"))
    assert right(PULearningModel.load(spark, str(tmp_path / "pu"))) == right(model)


def test_pu_needs_positives(spark, vectors):
    with pytest.raises(ValueError, match="positive rows"):
        pu_learning().fit(vectors.withColumn("y", F.lit(-1.0)))


def test_hold_out_ratio_is_checked():
    with pytest.raises(ValueError, match="between 0 and 1"):
        PULearningClassifier(None, hold_out_ratio=0)


def test_registered_feature_reaches_vectors_and_cells(spark, corpus):
    features.register("rare", TermFeature("idf * ilf", binary=True))
    try:
        rows, _ = jobs.prepare(corpus, "ok")
        model = FeatureExtractor(["rare"]).fit(rows)
        total = model.cells(rows).agg(F.sum("value")).first()[0]
        vectors = model.transform(rows).select(F.explode(vector_to_array("features")).alias("v"))
        assert vectors.agg(F.sum("v")).first()[0] == pytest.approx(total)
    finally:
        del features["rare"]
    with pytest.raises(KeyError, match="no feature named 'rare'"):
        FeatureModel(model.weights, ["rare"])


def test_vectors_hold_the_cells(spark, corpus):
    rows, _ = jobs.prepare(corpus, "ok")
    model = FeatureExtractor(["tfilf", "length", "tf"]).fit(rows)
    extra = rows.limit(1).selectExpr("-1L AS line_no", "array('unknown') AS tokens", "y")
    lines = rows.select("line_no", "tokens", "y").unionByName(extra)
    parts = model.transform(lines).select("line_no", F.unwrap_udt("features").alias("v"))
    cells = parts.select("line_no", F.inline(F.arrays_zip("v.indices", "v.values")))
    expected = model.cells(lines).where("value <> 0").select("line_no", F.col("idx").cast("int"), "value")
    assert cells.count() == expected.count() > 0
    assert cells.exceptAll(expected).isEmpty()
    assert {r.n for r in parts.select(F.col("v.size").alias("n")).collect()} == {model.width}
    assert parts.count() == lines.count()


@pytest.mark.parametrize("columns", [1, 3, 5, 100])
def test_bounded_columns(spark, corpus, tmp_path, columns):
    """The most frequent tokens keep their columns, all others share the last one of each block."""
    rows, _ = jobs.prepare(corpus, "ok")
    names = ["tfilf", "length", "tf"]
    model = FeatureExtractor(names, columns=columns).fit(rows)
    weights = {r.token: r for r in model.weights.collect()}
    place = {t: i for i, t in enumerate(sorted(weights, key=lambda t: (-weights[t].df, weights[t].idx)))}
    width = min(columns, len(weights)) + 1
    expected = {}
    for line in rows.collect():
        for token in set(line.tokens):
            at, tf = min(place[token], width - 1), line.tokens.count(token)
            for key, value in ((at, tf * weights[token].ilf), (width + 1 + at, weights[token].df)):
                expected[line.line_no, key] = expected.get((line.line_no, key), 0) + value
        expected[line.line_no, width] = len(line.tokens)
    vectors = model.transform(rows)
    got = {(r.line_no, r.idx): r.value for r in feature_models.vector_cells(vectors, "line_no").collect()}
    assert got == pytest.approx({k: v for k, v in expected.items() if v})
    assert model.width == 2 * width + 1 and vectors.first().features.size == model.width
    labels = {r.idx: r.name for r in model.feature_names().collect()}
    assert labels[width - 1] == "tfilf:REST" and labels[width] == "LENGTH" and labels[2 * width] == "tf:REST"
    assert all(labels[i] == f"tfilf:{t}" for t, i in place.items() if i < width - 1)
    model.save(str(tmp_path / "m"))
    again = FeatureModel.load(spark, str(tmp_path / "m")).transform(rows)
    assert again.select("line_no", "features").exceptAll(vectors.select("line_no", "features")).isEmpty()


def test_bounded_columns_need_one(spark, corpus):
    rows, _ = jobs.prepare(corpus, "ok")
    with pytest.raises(ValueError, match="at least one column"):
        FeatureExtractor(columns=0).fit(rows)


def test_vectors_of_equal_texts_are_made_once(spark, monkeypatch):
    """Ten lines to a text, an empty text and none at all: each is looked up once, all lines get its vector."""
    texts = [["a", "b", "a"], ["b"], ["c", "a"], [], None]
    lines = spark.createDataFrame(
        [(i, texts[i % 5], i % 3, "x") for i in range(50)], "line_no bigint, tokens array<string>, fold int, text string"
    )
    model = FeatureExtractor(["tfidf", "length"]).fit(lines)
    made, real = [], feature_models.line_cells
    monkeypatch.setattr(feature_models, "line_cells", lambda rows, *args: made.append(rows.count()) or real(rows, *args))
    vectors = model.transform(lines)
    assert made == [5]
    assert vectors.columns == ["line_no", "fold", "text", "features"]
    got = {r.line_no: r.features for r in vectors.collect()}
    assert len(got) == vectors.count() == 50
    few = {r.line_no: r.features for r in model.transform(lines.where("line_no < 5")).collect()}
    assert made == [5, 5] and len(few) == 5 and few[0].numNonzeros() == 3 and few[4].numNonzeros() == 0
    assert all(got[i] == few[i % 5] for i in range(50))
    weights = fit_split_weights(lines, 3)
    split = feature_models.split_vectors(lines, weights, 3, ["tfidf", "length"])
    assert split.count() == 150 and made[2:] == [15]


@pytest.mark.parametrize("columns, swap", [(None, False), (4, False), (None, True)])
def test_vectors_of_all_folds_equal_those_of_each(spark, corpus, columns, swap):
    rows, _ = jobs.prepare(corpus, "ok")
    folds = jobs._fold(rows, 3, swap, ["tfilf", "length"], columns)
    assert folds.vectors.count() == 3 * 360
    for fold in range(3):
        train, test = folds.train(fold), folds.test(fold)
        assert train.count() + test.count() == 360 and (train.count() < 130) == swap
        model = FeatureExtractor(["tfilf", "length"], columns).fit(rows.join(train.select("line_no"), "line_no"))
        assert folds.model(fold).width == model.width
        both = train.unionByName(test).select("line_no", "y", "features")
        assert both.exceptAll(model.transform(rows).select("line_no", "y", "features")).isEmpty()


def test_record_of_a_run(spark, corpus, tmp_path):
    settings = {"healthy": "ok", "k": 2, "features": ["tfilf"], "path": None}
    run = jobs.train_binary(corpus, "ok", k=2, binary_classifier="regular", numTrees=2)
    for name in ("a", "b"):
        stores.append_record(run.record(name, "train_binary", settings), str(tmp_path / "records"))
    rows = stores.load_records(spark, str(tmp_path / "records")).orderBy("run_id", "fold").collect()
    assert [(r.run_id, r.fold, r.best) for r in rows] == [("a", 0, True), ("a", 1, False), ("b", 0, True), ("b", 1, False)]
    assert rows[0].settings == {"healthy": "ok", "k": "2", "features": '["tfilf"]', "path": None}
    assert rows[0].scores == {"f1": 1.0} and rows[0].train_time > 0 and rows[0].run_time > 0
    typed = stores.load_records(spark, str(tmp_path / "records")).select(
        stores.setting("k", "int").alias("k"), stores.setting("features", "array<string>").alias("f")
    )
    assert typed.first() == (2, ["tfilf"])


def test_no_vocabulary_on_the_driver():
    source = inspect.getsource(feature_models)
    assert not any(word in source for word in ("toPandas", "collect()", "from_vocabulary", "MAX_"))


def test_forest_is_reproducible(spark, vectors):
    rows = vectors.withColumn("y", binary_truth(F.col("y")))
    a, b = (
        regular().fit(x).transform(rows).select("line_no", "pred")
        for x in (rows, rows.repartition(3))
    )
    assert a.exceptAll(b).count() == 0
    assert a.join(rows, "line_no").where("y <> pred").count() == 0


def test_forest_does_not_depend_on_the_session(spark):
    """The same scores for few and many shuffle partitions, with more rows than one task takes."""
    rows = spark.range(60_000).selectExpr(
        "id AS line_no", "IF(id % 5 = 0, 1D, -1D) AS y",
        "array(CAST(id % 5 AS DOUBLE), CAST(hash(id) % 100 AS DOUBLE)) AS v",
    )
    rows = rows.withColumn("features", array_to_vector("v")).drop("v")
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            model = pu_learning(numTrees=3, maxDepth=5).fit(rows)
            scores.append((model.c, model.transform(rows).agg(F.sum(F.round("p1", 12))).first()[0]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == scores[1]


def test_plain_forest_keeps_the_shares_of_mixed_lines(spark):
    """Leaves that name the same class stay apart: 60 % of one line are anomalous, all of another are."""
    kinds = [([1.0, 0.0], 10, 6), ([1.0, 1.0], 10, 10), ([0.0, 0.0], 10, 0)]
    rows = [(Vectors.dense(x), 1.0 if i < up else -1.0) for x, n, up in kinds for i in range(n)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["line_no", "features", "y"]).coalesce(1)
    model = regular(numTrees=1, bootstrap=False, featureSubsetStrategy="all").fit(rows)
    scored = classifiers._probability_one(model.model, rows).select("p1").distinct().collect()
    assert sorted(r.p1 for r in scored) == pytest.approx([0.0, 0.6, 1.0])


def test_whole_forests_pass_over_equal_rows_once(spark, vectors, monkeypatch):
    """Trees of all rows are the same from counted rows; those of a bootstrap still get every row."""
    rows = vectors.withColumn("y", binary_truth(F.col("y"))).select("line_no", "y", "features")
    rows = rows.withColumn("y", F.when(F.col("line_no") % 5 == 0, -F.col("y")).otherwise(F.col("y"))).cache()
    fitted = []
    fit = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, r: fitted.append(r.count()) or fit(self, r))
    whole = {"bootstrap": False, "featureSubsetStrategy": "all", "numTrees": 2, "maxDepth": 6}
    ours = regular(**whole).fit(rows).transform(rows)
    assert fitted == [rows.select("y", "features").distinct().count()]
    assert fitted[0] < rows.count()
    plain = RandomForestClassifier(impurity="gini", seed=0, **whole)
    plain = plain.fit(rows.withColumn("label", (F.col("y") == 1).cast("double"))).transform(rows)
    same = ours.join(plain.select("line_no", "prediction"), "line_no")
    assert same.where((F.col("pred") == 1) != (F.col("prediction") == 1)).count() == 0
    regular(numTrees=2, maxDepth=2).fit(rows)
    assert fitted[-1] == rows.count()


def test_svm_keeps_class_ids_with_gaps(spark, vectors, tmp_path):
    rows = vectors.where("y <> -1").withColumn("y", F.col("y") * 10 + 5)
    ids = {r.y for r in rows.select("y").distinct().collect()}
    model = svm().fit(rows)
    preds = model.transform(rows)
    assert {r.pred for r in preds.collect()} == ids
    assert preds.where("y <> pred").count() == 0
    model.save(str(tmp_path / "svm"))
    again = SvmModel.load(spark, str(tmp_path / "svm"))
    assert again.transform(rows).select("line_no", "pred").exceptAll(
        preds.select("line_no", "pred")
    ).isEmpty()
    assert {r.class_id for r in again.coefficients(spark).collect()} == ids


def test_svm_passes_over_equal_rows_once(spark, monkeypatch):
    """Repeated lines weigh as much as they come and are one training row; the fit is that of all rows."""
    rng = np.random.default_rng(0)
    x, copies = rng.normal(size=(60, 5)), rng.integers(1, 9, 60)
    y = (x[:, 0] + x[:, 1] / 2 + rng.normal(size=60) / 2 > 0).astype(float)
    rows = [(float(y[i]), Vectors.dense(x[i])) for i in np.repeat(np.arange(60), copies)]
    rows = [(line_no, *row) for line_no, row in enumerate(rows)]
    every = spark.createDataFrame(rows, ["line_no", "y", "features"]).coalesce(1).cache()
    seen = []
    layout = classifiers.training_rows
    monkeypatch.setattr(classifiers, "training_rows", lambda rows, *rest: seen.append(rows) or layout(rows, *rest))
    params = {"tol": 1e-6, "maxIter": 30, "regParam": 0.05, "standardization": False}
    model = svm(**params).fit(every)
    assert seen[0].agg(F.count("*"), F.sum("weight")).first() == (60, len(rows))
    plain = LinearSVC(labelCol="y", **params).fit(every)
    of_class = model.stages.stages[0].models[1]
    assert of_class.coefficients.toArray() == pytest.approx(plain.coefficients.toArray(), abs=0.02)


def test_global_job(spark, corpus, tmp_path):
    path = str(tmp_path / "run")
    run = jobs.train_global(corpus, "ok", reports=["macro", "top_k_svm"], path=path)
    assert run.results.count() == 3
    assert run.results.agg(F.min("f1"), F.min("accuracy")).first() == (1.0, 1.0)
    assert run.binary.count() == 360
    top = run.reports["multi", "top_k_svm"].where("rank = 1").collect()
    first = corpus.where("label <> 'ok'").orderBy("line_no").first().label
    assert [r.label for r in top] == [first]  # of two classes only the first
    assert all(r.name in WORDS[r.label].split() for r in top)
    assert run.results.where("train_time > 0 AND run_time > 0").count() == 3
    scored = jobs.score_global(corpus, path, reports=["micro"])
    assert scored.results.first() == (1.0, 1.0)
    new = corpus.unionByName(
        spark.createDataFrame(
            [
                (900, "ok", WORDS["disk"]),  # healthy in truth, found by the detector
                (901, "net", WORDS["ok"]),  # an anomaly that the detector misses
                (902, "fan", WORDS["net"]),  # a class that training did not have
                (903, "fan", ""),
            ],
            corpus.schema,
        )
    )
    cascade = jobs.score_global(new, path, cascade=True)
    ids = {r.label: r.class_id for r in spark.read.parquet(f"{path}/classes").collect()}
    odd = {r.line_no: tuple(r)[1:] for r in cascade.lines.where("line_no >= 900").collect()}
    assert odd[900] == ("ok", -1.0, 1.0, ids["disk"])
    assert odd[901] == ("net", ids["net"], -1.0, None)
    assert odd[902] == ("fan", None, 1.0, ids["net"])
    assert odd[903][:2] == ("fan", None)
    found = corpus.where("label <> 'ok'").count() + sum(r[3] is not None for r in odd.values())
    assert cascade.multi.count() == found and cascade.lines.count() == new.count()
    plain = jobs.score_global(new, path).lines
    assert plain.where("(pred IS NULL) <> (label = 'ok')").isEmpty()


def test_binary_job(spark, corpus, tmp_path):
    path = str(tmp_path / "run")
    run = jobs.train_binary(corpus, "ok", k=2, binary_classifier="regular", path=path)
    assert run.results.agg(F.min("f1")).first()[0] == 1.0
    scored = jobs.score_binary(corpus, path)
    assert scored.results.first().f1 == 1.0
    cells = {(r.y, r.pred): r.n for r in scored.reports["binary", "confusion_matrix"].collect()}
    assert cells[1.0, -1.0] == cells[-1.0, 1.0] == 0


def test_multi_job_swapped(spark, corpus, tmp_path):
    run = jobs.train_multi(corpus, "ok", k=3, swap=True, path=str(tmp_path / "run"))
    assert run.results.columns == [
        "exp_name", "logs_type", "fold", "macro", "micro", "train_time", "run_time"
    ]
    assert run.multi.count() == 2 * corpus.where("label <> 'ok'").count()
    assert run.results.agg(F.min("macro")).first()[0] > 0.95
    saved = spark.read.option("header", True).csv(str(tmp_path / "run" / "results"))
    assert saved.count() == 3


def test_robustness_sweep(spark, corpus):
    run = jobs.pu_robustness(
        corpus, "ok", ratio=2, top_percentage=21, step=20, k=2, numTrees=5, maxDepth=8
    )
    rows = run.results.orderBy("fold", "percentage").collect()
    assert [(r.fold, r.percentage) for r in rows] == [(0, 0), (0, 20), (1, 0), (1, 20)]
    assert all(r.pu_f1 > 0.9 for r in rows)
    assert all(r.regular_f1 == 1.0 for r in rows if r.percentage == 0)


def test_registered_for_a_block_only():
    names = Registry("thing")
    names.register("a", 1)
    with names.registered("a", 2), names.registered("b", 3):
        assert names == {"a": 2, "b": 3}
    assert names == {"a": 1}
    with pytest.raises(RuntimeError), names.registered("b", 3):
        raise RuntimeError
    assert names == {"a": 1}
    with pytest.raises(KeyError, match="no thing named 'b'"):
        names.unregister("b")
