"""The registered queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift import registry
from logsift.functions import text as T
from logsift.models.classifiers import stored_coefficients
from logsift.models.features import FeatureExtractor, FeatureModel, vector_cells
from logsift.operators import features as FE
from logsift.operators import labels as L
from logsift.operators import preprocess as P
from logsift.operators import pu
from logsift.operators import reports as R
from logsift.operators import splits as S
from logsift.operators import vocabulary as V
from logsift.plans import jobs
from logsift.registry import binary_models, multi_models, preprocessors
from logsift.sources import datasets, files, stores  # noqa: F401  datasets registers the preprocessors
from logsift.sources.scratch import materialize, scratch_path
from workload import inputs as I
from workload.inputs import duck_clean_tokens, duck_strip, duck_tokens, with_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query, and its SQL behind the named CTEs."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return function

    return add


DOCS = ("log_docs", "docs")
WEIGHTS = (*DOCS, "words", "totals", "vocab", "weights")
TERMS = (*WEIGHTS, "terms")
FOLDS = (*DOCS, "classes", "encoded", "folds")
TRAIN = (*FOLDS, "train_words", "train_vocab", "test_words")


# -- cleaning and parsing ---------------------------------------------------------------------------


def _cleaned(lines: DataFrame, source: str) -> DataFrame:
    message = T.clean_parameters(F.col("raw"))
    return P.keep_non_empty(lines, "message", message).select(
        F.lit(source).alias("source"), "line_no", "message"
    )


@query(
    "clean_parameters",
    """SELECT 'docs' AS source, line_no, array_to_string(toks, ' ') AS message FROM docs
    UNION ALL SELECT 'events', line_no, array_to_string(toks, ' ') FROM cleaned_events""",
    *DOCS,
    "log_events",
    "cleaned_events",
)
def clean_parameters(spark, sf_dir):
    return _cleaned(I.log_docs(spark, sf_dir), "docs").unionByName(
        _cleaned(I.log_events(spark, sf_dir), "events")
    )


@query(
    "clean_drop_first",
    f"""SELECT line_no, label, array_to_string({duck_tokens("raw")}[2:], ' ') AS rest
    FROM log_events""",
    "log_events",
)
def clean_drop_first(spark, sf_dir):
    return I.log_events(spark, sf_dir).select(
        "line_no", "label", T.drop_first_token(F.col("raw")).alias("rest")
    )


BGL_PARSED = f"""SELECT line_no, label, array_to_string(toks, ' ') AS message FROM (
        SELECT line_no,
            CASE WHEN regexp_extract(line, '{I.DUCK_WORD}+{I.DUCK_WS}+(INFO|WARN|ERROR|FATAL)', 1)
                = 'INFO' THEN 'unlabeled'
            ELSE regexp_extract(line, '({I.DUCK_WORD}+){I.DUCK_WS}+(INFO|WARN|ERROR|FATAL)', 1)
            END AS label, {duck_clean_tokens("body")} AS toks
        FROM (
            SELECT line_no, line, {duck_strip("regexp_replace(piece, '^.*x''.+''', '')")} AS body
            FROM (
                SELECT line_no, line, {duck_strip(
                    "string_split(" + duck_strip("regexp_extract(line, '(?:-.{1,3}){2} (.+)$', 1)")
                    + ", '   ')[-1]"
                )} AS piece
                FROM (SELECT line_no, {duck_strip("raw")} AS line FROM log_bgl)
            )
            WHERE regexp_matches(line, '^\\p{{Nd}}')
              AND regexp_extract(line, '{I.DUCK_WORD}+{I.DUCK_WS}+(INFO|WARN|ERROR|FATAL)', 1)
                  IN ('INFO', 'ERROR', 'FATAL')
        ) WHERE length(body) > 20
    ) WHERE len(toks) > 0"""


@query("bgl_parse", BGL_PARSED, "log_bgl")
def bgl_parse(spark, sf_dir):
    return P.preprocess_bgl(I.log_bgl(spark, sf_dir))


@query(
    "paired_join",
    f"""SELECT line_no, label, array_to_string(toks, ' ') AS message FROM (
        SELECT line_no, label, {duck_clean_tokens(
            "array_to_string(" + duck_tokens("raw") + "[2:], ' ')")} AS toks
        FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no,
                     concat('quality', quality, '/toxic', toxic) AS label FROM labels)
        JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, text AS raw
              FROM documents) USING (line_no)
    ) WHERE len(toks) > 0""",
)
def paired_join(spark, sf_dir):
    """The i-th labeled document's label against the i-th document: the label side is shorter."""
    truth = P.number_lines(I.table(spark, sf_dir, "labels"), "doc_id").select(
        "line_no", F.concat(F.lit("quality"), "quality", F.lit("/toxic"), "toxic").alias("label")
    )
    raw = I.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))
    return P.paired_corpus(truth, raw, "doc_id")


@query(
    "corpus_parse",
    f"""SELECT line_no, words[1] AS label, array_to_string(words[2:], ' ') AS message
    FROM (SELECT line_no, {duck_tokens("raw")} AS words FROM log_docs) WHERE len(words) > 0""",
    "log_docs",
)
def corpus_parse(spark, sf_dir):
    lines = I.log_docs(spark, sf_dir).select("line_no", F.col("raw").alias("value"))
    return P.parse_corpus(lines)


@query(
    "tokenize",
    f"""SELECT line_no, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS token
    FROM (SELECT line_no, {duck_tokens("raw")} AS words FROM log_docs)""",
    "log_docs",
)
def tokenize(spark, sf_dir):
    lines = I.log_docs(spark, sf_dir).select("line_no", F.col("raw").alias("message"))
    return V.token_rows(V.tokenize(lines), "line_no").withColumn("pos", F.col("pos").cast("bigint"))


def _ngrams(n: int) -> Query:
    def run(spark, sf_dir):
        lines = I.clean_lines(I.log_docs(spark, sf_dir))
        grams = F.posexplode(T.ngrams(F.col("tokens"), n)).alias("pos", "gram")
        return lines.select("line_no", grams).withColumn("pos", F.col("pos").cast("bigint"))

    return run


for n in (2, 3):
    query(
        f"ngrams_{n}",
        f"""SELECT line_no, i - 1 AS pos, array_to_string(toks[i:i + {n - 1}], ' ') AS gram
        FROM (SELECT line_no, toks, unnest(range(1, greatest(len(toks) - {n - 2}, 2))) AS i
              FROM docs)""",
        *DOCS,
    )(_ngrams(n))


# -- labels -------------------------------------------------------------------------------------------


@query("label_encode", "SELECT line_no, label, y FROM encoded", *FOLDS[:-1])
def label_encode(spark, sf_dir):
    lines = I.docs(spark, sf_dir).select("line_no", "label")
    return L.encode_labels(lines, I.HEALTHY_SOURCE)[0]


@query(
    "label_encode_no_healthy",
    f"""SELECT line_no, label, y FROM docs JOIN (
        SELECT label, (row_number() OVER (ORDER BY min(line_no)) - 1)::DOUBLE AS y FROM docs
        WHERE label <> '{I.HEALTHY_SOURCE}' GROUP BY label) USING (label)""",
    *DOCS,
)
def label_encode_no_healthy(spark, sf_dir):
    lines = I.docs(spark, sf_dir).select("line_no", "label")
    return L.encode_labels(lines, I.HEALTHY_SOURCE, ignore_healthy=True)[0]


@query(
    "target_names",
    "SELECT label, y AS class_id FROM classes WHERE y <> -1",
    *DOCS,
    "classes",
)
def target_names(spark, sf_dir):
    lines = I.docs(spark, sf_dir).select("line_no", "label")
    return L.target_names(L.fit_classes(lines, I.HEALTHY_SOURCE))


def _encoded(spark, sf_dir, *columns) -> DataFrame:
    return I.encoded(I.docs(spark, sf_dir).select("line_no", "label", *columns), I.HEALTHY_SOURCE)


@query(
    "binary_truth",
    """SELECT CASE WHEN y = -1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS y, count(*) AS n
    FROM encoded GROUP BY 1""",
    *FOLDS[:-1],
)
def binary_truth(spark, sf_dir):
    return L.class_balance(_encoded(spark, sf_dir))


@query("anomalous_only", "SELECT line_no, y FROM encoded WHERE y <> -1", *FOLDS[:-1])
def anomalous_only(spark, sf_dir):
    return L.anomalous_only(_encoded(spark, sf_dir)).select("line_no", "y")


# -- vocabulary and weights -----------------------------------------------------------------------------


def _stats(spark, sf_dir) -> DataFrame:
    return V.fit_stats(I.clean_lines(I.log_docs(spark, sf_dir)))


@query("vocabulary", "SELECT token, idx FROM vocab", *DOCS, "words", "vocab")
def vocabulary(spark, sf_dir):
    return V.vocabulary(_stats(spark, sf_dir))


@query("doc_freq", "SELECT token, df FROM vocab", *DOCS, "words", "vocab")
def doc_freq(spark, sf_dir):
    lines = I.clean_lines(I.log_docs(spark, sf_dir))
    return V.token_stats(V.token_places(lines)).where("token IS NOT NULL").select("token", "df")


@query("loc_freq", "SELECT token, lf FROM vocab", *DOCS, "words", "vocab")
def loc_freq(spark, sf_dir):
    lines = I.clean_lines(I.log_docs(spark, sf_dir))
    return V.token_stats(V.token_places(lines)).where("token IS NOT NULL").select("token", "lf")


@query("max_line", "SELECT n_lines, max_len FROM totals", *DOCS, "totals")
def max_line(spark, sf_dir):
    lines = I.clean_lines(I.log_docs(spark, sf_dir))
    return V.corpus_totals(V.token_stats(V.token_places(lines)))


@query("idf", "SELECT token, round(idf, 6) AS idf FROM weights", *WEIGHTS)
def idf(spark, sf_dir):
    return V.weights(_stats(spark, sf_dir)).select("token", F.round("idf", 6).alias("idf"))


@query("ilf", "SELECT token, round(ilf, 6) AS ilf FROM weights", *WEIGHTS)
def ilf(spark, sf_dir):
    return V.weights(_stats(spark, sf_dir)).select("token", F.round("ilf", 6).alias("ilf"))


def _each_training_set(spark, sf_dir, function):
    """``function(test lines, weights)`` of all three folds, weights from one pass, as ``split``."""
    lines = materialize(
        S.stratified_kfold(_encoded(spark, sf_dir, "tokens"), 3).drop("label"), "folds"
    )
    weights = V.fit_split_weights(lines, 3)
    parts = [
        function(
            S.test_part(lines, i), weights.where(F.col("split") == i).drop("split")
        ).withColumn("split", F.lit(i))
        for i in range(3)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "vectorize_oov",
    """SELECT split, line_no, row_number() OVER (PARTITION BY line_no ORDER BY pos) - 1 AS pos, idx
    FROM test_words JOIN train_vocab USING (split, token)""",
    *TRAIN,
)
def vectorize_oov(spark, sf_dir):
    lines = materialize(S.stratified_kfold(_encoded(spark, sf_dir, "tokens"), 3).drop("label"), "folds")
    vocab = V.fit_split_vocabulary(lines, 3)
    found = V.vectorize(lines.withColumn("split", F.col("fold")), vocab, ["split"])
    return found.withColumn("pos", F.col("pos").cast("bigint"))


# -- features -----------------------------------------------------------------------------------------


def _features(*names: str) -> Query:
    def run(spark, sf_dir):
        lines = I.docs(spark, sf_dir).select("line_no", "tokens")
        cells = FE.feature_cells(lines, V.fit_weights(lines), names)
        return cells.select("line_no", "block", "idx", F.round("value", 6).alias("value"))

    return run


for name, value in (("tfidf", "tf * idf"), ("tfilf", "tf * ilf"), ("tf", "df::DOUBLE")):
    query(
        f"feature_{name}",
        f"""SELECT line_no, 0 AS block, idx, round({value}, 6) AS value
        FROM terms JOIN weights USING (token)""",
        *TERMS,
    )(_features(name))

query(
    "feature_length",
    """SELECT line_no, 0 AS block, 0::BIGINT AS idx, len(toks)::DOUBLE AS value FROM docs""",
    *DOCS,
)(_features("length"))

query(
    "feature_concat",
    """SELECT line_no, 0 AS block, idx, round(tf * ilf, 6) AS value
    FROM terms JOIN weights USING (token)
    UNION ALL SELECT line_no, 1, (SELECT count(*) FROM vocab), len(toks)::DOUBLE FROM docs
    UNION ALL SELECT line_no, 2, (SELECT count(*) FROM vocab) + 1 + idx, round(tf * idf, 6)
    FROM terms JOIN weights USING (token)""",
    *TERMS,
)(_features("tfilf", "length", "tfidf"))


@query(
    "feature_vectors",
    """SELECT line_no, idx, round(tf * ilf, 6) AS value
    FROM terms JOIN weights USING (token) WHERE tf * ilf <> 0
    UNION ALL SELECT line_no, (SELECT count(*) FROM vocab), len(toks)::DOUBLE FROM docs
    UNION ALL SELECT line_no, (SELECT count(*) FROM vocab) + 1 + idx, round(tf * idf, 6)
    FROM terms JOIN weights USING (token) WHERE tf * idf <> 0""",
    *TERMS,
)
def feature_vectors(spark, sf_dir):
    """The same cells as ``feature_concat``, unfolded from the stored MLlib vectors."""
    lines = I.docs(spark, sf_dir).select("line_no", "tokens")
    model = FeatureExtractor(["tfilf", "length", "tfidf"]).fit(lines)
    cells = vector_cells(model.transform(lines), "line_no")
    return cells.select("line_no", F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value"))


@query(
    "feature_test_fold",
    """SELECT split, line_no, 0 AS block, idx, round(count(*) * min(ilf), 6) AS value
    FROM test_words JOIN train_weights USING (split, token) GROUP BY split, line_no, idx
    UNION ALL SELECT split, line_no, 1, min(n), count(idx)::DOUBLE
    FROM test_words LEFT JOIN train_vocab USING (split, token)
        JOIN (SELECT split, count(*) AS n FROM train_vocab GROUP BY split) USING (split)
    GROUP BY split, line_no""",
    *TRAIN,
    "train_totals",
    "train_weights",
)
def feature_test_fold(spark, sf_dir):
    """Features of every fold by the weights of the other two, all sets counted in one pass."""
    cells = _each_training_set(
        spark, sf_dir, lambda lines, weights: FE.feature_cells(lines, weights, ["tfilf", "length"])
    )
    return cells.select("split", "line_no", "block", "idx", F.round("value", 6).alias("value"))


@query(
    "minmax_scale",
    """SELECT line_no, idx, round(2 * (value - lo) / (hi - lo) - 1, 6) AS value,
        round(2 * (0 - lo) / (hi - lo) - 1, 6) AS background
    FROM cells, (SELECT least(min(value), CASE WHEN count(*) < (SELECT n_lines FROM totals)
                                * (SELECT count(*) FROM vocab) THEN 0 ELSE min(value) END) AS lo,
                        greatest(max(value), CASE WHEN count(*) < (SELECT n_lines FROM totals)
                                * (SELECT count(*) FROM vocab) THEN 0 ELSE max(value) END) AS hi
                 FROM cells)""",
    *TERMS,
    "cells",
)
def minmax_scale(spark, sf_dir):
    lines = I.docs(spark, sf_dir).select("line_no", "tokens")
    weights = V.fit_weights(lines)
    cells = FE.feature_cells(lines, weights, ["tfilf"])
    n_cells = lines.agg(F.count("*")).scalar() * weights.agg(F.count("*")).scalar()
    scaled = FE.scale_to_unit_range(cells, n_cells)
    return scaled.select(
        "line_no",
        "idx",
        F.round("value", 6).alias("value"),
        F.round("background", 6).alias("background"),
    )


@query(
    "dedup_first",
    """SELECT array_to_string(toks, ' ') AS message, arg_min(y, line_no) AS y
    FROM encoded GROUP BY 1""",
    *FOLDS[:-1],
)
def dedup_first(spark, sf_dir):
    rows = _encoded(spark, sf_dir, "tokens").withColumn("message", F.array_join("tokens", " "))
    return FE.dedup_messages(rows)


# -- splits -------------------------------------------------------------------------------------------


@query("stratified_kfold", "SELECT line_no, y, fold FROM folds", *FOLDS)
def stratified_kfold(spark, sf_dir):
    folds = S.stratified_kfold(_encoded(spark, sf_dir), 3)
    return folds.select("line_no", "y", F.col("fold").cast("bigint").alias("fold"))


@query(
    "kfold_swap",
    """SELECT s.split, f.y, count(*) FILTER (f.fold = s.split) AS n_train,
        count(*) FILTER (f.fold <> s.split) AS n_test
    FROM folds f, (SELECT unnest(range(3)) AS split) s GROUP BY s.split, f.y""",
    *FOLDS,
)
def kfold_swap(spark, sf_dir):
    """Sizes of the swapped parts: train on the one fold, test on the others."""
    folds = materialize(S.stratified_kfold(_encoded(spark, sf_dir), 3), "folds")
    sizes = None
    for split in range(3):
        parts = [
            part(folds, split, swap=True).select("y", F.lit(name).alias("part"))
            for name, part in (("train", S.train_part), ("test", S.test_part))
        ]
        counts = (
            parts[0]
            .unionByName(parts[1])
            .groupBy(F.lit(split).cast("bigint").alias("split"), "y")
            .agg(
                F.count_if(F.col("part") == "train").alias("n_train"),
                F.count_if(F.col("part") == "test").alias("n_test"),
            )
        )
        sizes = counts if sizes is None else sizes.unionByName(counts)
    return sizes


def _hash_sql(seed) -> str:
    return f"substr(md5(concat('{seed}', '|', line_no)), 1, 15), line_no"


def _force_ratio_sql(rows: str, ratio: int) -> str:
    return f"""SELECT line_no, y FROM (
        SELECT line_no, y, row_number() OVER (PARTITION BY y ORDER BY {_hash_sql(10)}) AS place,
            count(*) FILTER (y = 1) OVER () AS n_pos, count(*) FILTER (y = -1) OVER () AS n_unl
        FROM {rows})
    WHERE place <= CASE WHEN n_pos * {ratio} <= n_unl
        THEN CASE WHEN y = 1 THEN n_pos ELSE n_pos * {ratio} END
        ELSE CASE WHEN y = 1 THEN n_unl // {ratio} ELSE n_unl END END"""


@query("force_ratio", _force_ratio_sql("scored_docs", 8), "scored_docs")
def force_ratio(spark, sf_dir):
    """Few positives: all are kept, with 8 unlabeled documents each."""
    return S.force_ratio(I.scored_docs(spark, sf_dir).select("line_no", "y"), 8)


@query("force_ratio_scarce_healthy", _force_ratio_sql("binary_events", 8), "binary_events")
def force_ratio_scarce_healthy(spark, sf_dir):
    """Many positives: all unlabeled events are kept, with one positive for each 8."""
    return S.force_ratio(I.binary_events(spark, sf_dir), 8)


@query(
    "shuffle",
    f"SELECT line_no, y, row_number() OVER (ORDER BY {_hash_sql(5)}) - 1 AS place FROM binary_events",
    "binary_events",
)
def shuffle(spark, sf_dir):
    return S.shuffle_order(I.binary_events(spark, sf_dir))


@query(
    "label_noise",
    f"""SELECT i AS percentage, line_no, y,
        CASE WHEN y = 1 AND place <= i * n_unl // (100 - i) THEN -1.0::DOUBLE ELSE y END AS y_noisy
    FROM (SELECT line_no, y, row_number() OVER (PARTITION BY y ORDER BY {_hash_sql(5)}) AS place,
                 count(*) FILTER (y = -1) OVER () AS n_unl FROM binary_events),
        (SELECT unnest(range(0, 11)) AS i)""",
    "binary_events",
)
def label_noise(spark, sf_dir):
    noisy = S.label_noise(I.binary_events(spark, sf_dir), 11, 1)
    return noisy.select(F.col("percentage").cast("bigint"), "line_no", "y", "y_noisy")


HOLDOUT = f"""SELECT line_no, y, p1, y = 1 AND place <= ceil(n_pos * 0.1::DOUBLE) AS is_holdout
    FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_hash_sql(0)}) AS place,
                 count(*) FILTER (y = 1) OVER () AS n_pos FROM scored_docs)"""
PU_C = f"SELECT avg(p1) FILTER (is_holdout) AS c FROM ({HOLDOUT})"


@query("holdout_split", f"SELECT line_no, y, is_holdout FROM ({HOLDOUT})", "scored_docs")
def holdout_split(spark, sf_dir):
    return S.holdout_split(I.scored_docs(spark, sf_dir)).drop("p1")


@query("pu_constant", f"SELECT round(c, 6) AS c FROM ({PU_C})", "scored_docs")
def pu_constant(spark, sf_dir):
    split = S.holdout_split(I.scored_docs(spark, sf_dir))
    return pu.pu_constant(split).select(F.round("c", 6).alias("c"))


@query(
    "pu_score",
    f"SELECT line_no, round(p1 / c, 6) AS score FROM scored_docs, ({PU_C})",
    "scored_docs",
)
def pu_score(spark, sf_dir):
    scored = I.scored_docs(spark, sf_dir)
    c = pu.pu_constant(S.holdout_split(scored)).scalar()
    return scored.select("line_no", F.round(pu.pu_score(F.col("p1"), c), 6).alias("score"))


@query(
    "pu_decide",
    f"""SELECT line_no, CASE WHEN p1 / c > 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS pred
    FROM scored_docs, ({PU_C})""",
    "scored_docs",
)
def pu_decide(spark, sf_dir):
    scored = I.scored_docs(spark, sf_dir)
    c = pu.pu_constant(S.holdout_split(scored)).scalar()
    return scored.select("line_no", pu.pu_decision(F.col("p1"), c).alias("pred"))


# -- reports ------------------------------------------------------------------------------------------

PER_LABEL = """SELECT label, count(*) FILTER (y = label AND pred = label) AS tp,
        count(*) FILTER (y <> label AND pred = label) AS fp,
        count(*) FILTER (y = label AND pred <> label) AS fn
    FROM order_preds, (SELECT y AS label FROM order_preds UNION SELECT pred FROM order_preds)
    GROUP BY label"""


@query(
    "f1_binary",
    """SELECT round(2 * count(*) FILTER (y = 1 AND pred = 1)
        / (count(*) FILTER (y = 1) + count(*) FILTER (pred = 1))::DOUBLE, 6) AS f1
    FROM binary_preds""",
    "binary_preds",
)
def f1_binary(spark, sf_dir):
    scores = R.f1_binary(I.binary_order_predictions(spark, sf_dir))
    return scores.select(F.round("f1", 6).alias("f1"))


@query(
    "accuracy",
    "SELECT round(avg((y = pred)::INT::DOUBLE), 6) AS accuracy FROM order_preds",
    "order_preds",
)
def accuracy(spark, sf_dir):
    scores = R.accuracy(I.order_predictions(spark, sf_dir))
    return scores.select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "f1_macro",
    f"SELECT round(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE), 6) AS macro FROM ({PER_LABEL})",
    "order_preds",
)
def f1_macro(spark, sf_dir):
    scores = R.f1_macro(I.order_predictions(spark, sf_dir))
    return scores.select(F.round("macro", 6).alias("macro"))


@query(
    "f1_micro",
    f"""SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 6) AS micro
    FROM ({PER_LABEL})""",
    "order_preds",
)
def f1_micro(spark, sf_dir):
    scores = R.f1_micro(I.order_predictions(spark, sf_dir))
    return scores.select(F.round("micro", 6).alias("micro"))


@query(
    "confusion",
    """SELECT a.label AS y, b.label AS pred, count(p.line_no) AS n
    FROM (SELECT y AS label FROM order_preds UNION SELECT pred FROM order_preds) a
    CROSS JOIN (SELECT y AS label FROM order_preds UNION SELECT pred FROM order_preds) b
    LEFT JOIN order_preds p ON p.y = a.label AND p.pred = b.label GROUP BY 1, 2""",
    "order_preds",
)
def confusion(spark, sf_dir):
    return R.confusion(I.order_predictions(spark, sf_dir))


@query(
    "top_k_terms",
    """SELECT label, rank, token AS name, coef FROM (
        SELECT label, token, coef,
            row_number() OVER (PARTITION BY label ORDER BY coef DESC, idx DESC) AS rank
        FROM (SELECT label, token, idx, round(sum(tf * ilf) / min(n), 6) AS coef
              FROM terms JOIN weights USING (token) JOIN docs USING (line_no)
              JOIN (SELECT label, count(*) AS n FROM docs GROUP BY label) USING (label)
              GROUP BY label, token, idx))
    WHERE rank <= 5""",
    *TERMS,
)
def top_k_terms(spark, sf_dir):
    """Coefficient of a term in a class: its mean weighted count over the lines of the class."""
    lines = I.docs(spark, sf_dir)
    weights = V.fit_weights(lines)
    sizes = materialize(lines.groupBy("label").agg(F.count("*").alias("n")), "class-sizes")
    terms = V.line_terms(lines, "label").join(weights, "token")
    coefficients = (
        terms.groupBy("label", "idx")
        .agg(F.sum(F.col("tf") * F.col("ilf")).alias("total"))
        .join(sizes, "label")
        .select("label", "idx", F.round(F.col("total") / F.col("n"), 6).alias("coef"))
    )
    return R.top_k_terms(coefficients, weights.select("idx", F.col("token").alias("name")))


@query(
    "best_fold",
    """SELECT fold, round(macro, 6) AS macro FROM (
        SELECT fold, avg(2 * tp / (2 * tp + fp + fn)::DOUBLE) AS macro FROM (
            SELECT fold, label, count(*) FILTER (y = label AND pred = label) AS tp,
                count(*) FILTER (y <> label AND pred = label) AS fp,
                count(*) FILTER (y = label AND pred <> label) AS fn
            FROM (SELECT *, ntile(5) OVER (PARTITION BY y ORDER BY line_no) - 1 AS fold
                  FROM order_preds),
                (SELECT y AS label FROM order_preds UNION SELECT pred FROM order_preds)
            GROUP BY fold, label HAVING tp + fp + fn > 0)
        GROUP BY fold)
    ORDER BY macro DESC, fold LIMIT 1""",
    "order_preds",
)
def best_fold(spark, sf_dir):
    folds = S.stratified_kfold(I.order_predictions(spark, sf_dir), 5)
    best = R.best_fold(R.f1_macro(folds, ["fold"]), "macro")
    return best.select(F.col("fold").cast("bigint"), F.round("macro", 6).alias("macro"))


# -- files and stores ---------------------------------------------------------------------------------


@query(
    "raw_scan",
    "SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, raw FROM log_events",
    "log_events",
)
def raw_scan(spark, sf_dir):
    """Event lines written as text files and read back with line numbers."""
    path = scratch_path(spark, "raw")
    lines = I.log_events(spark, sf_dir)
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("raw").write.text(
        path
    )
    return files.read_log_lines(spark, path)


@query(
    "corpus_text",
    """SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, label,
        array_to_string(toks, ' ') AS message FROM docs""",
    *DOCS,
)
def corpus_text(spark, sf_dir):
    """The cleaned corpus written as latin-1 text and parsed back."""
    path = scratch_path(spark, "corpus")
    corpus = I.clean_lines(I.log_docs(spark, sf_dir)).select(
        "line_no", "label", F.array_join("tokens", " ").alias("message")
    )
    files.write_corpus_text(corpus, path)
    return files.read_corpus_text(spark, path)


# Bytes above 127 in a word, as a separator (the no-break space and the next-line character) and alone.
ODD_WORDS = "' caf', chr(233), ' re', chr(233), 'ntry sp', chr(233), 'cial', chr(160), 'joined', chr(133), 'ends ', chr(215)"
ODD_LINE = f"concat(raw, {ODD_WORDS})"


@query(
    "paired_files",
    f"""SELECT line_no, label, array_to_string(toks, ' ') AS message FROM (
        SELECT line_no, label, {duck_clean_tokens(
            "array_to_string(" + duck_tokens(ODD_LINE) + "[2:], ' ')")} AS toks
        FROM (SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, concat(label, chr(223)) AS label, raw,
                     count(*) OVER () AS n FROM log_events)
        WHERE line_no < n - n // 10) WHERE len(toks) > 0""",
    "log_events",
)
def paired_files(spark, sf_dir):
    """A label file and a log file of latin-1 bytes, the labels a tenth shorter, read as a known dataset."""
    folder = scratch_path(spark, "open-log")
    events = P.number_lines(I.log_events(spark, sf_dir).withColumnRenamed("line_no", "id"), "id")
    events = materialize(events.selectExpr("line_no", "concat(label, chr(223)) AS label", f"{ODD_LINE} AS raw"), "events")
    n = events.count()
    files.write_paired_lines(events.where(F.col("line_no") < n - n // 10), events, folder)
    return preprocessors["open_hdfs"].corpus(spark, folder)


@query(
    "results_csv",
    """SELECT fold, round(avg((y = pred)::INT::DOUBLE), 6) AS accuracy
    FROM (SELECT *, ntile(5) OVER (PARTITION BY y ORDER BY line_no) - 1 AS fold FROM order_preds)
    GROUP BY fold""",
    "order_preds",
)
def results_csv(spark, sf_dir):
    """Scores per fold written as CSV and read back."""
    folds = S.stratified_kfold(I.order_predictions(spark, sf_dir), 5)
    scores = R.accuracy(folds, ["fold"]).select("fold", F.round("accuracy", 6).alias("accuracy"))
    path = scratch_path(spark, "results")
    stores.save_results(scores, path)
    return stores.load_results(spark, path, "fold BIGINT, accuracy DOUBLE")


# -- flagship -----------------------------------------------------------------------------------------


@query(
    "weighted_terms",
    """SELECT line_no, token, tf, round(ilf, 6) AS ilf, round(tf * ilf, 6) AS tfilf
    FROM terms JOIN weights USING (token)""",
    *TERMS,
)
def weighted_terms(spark, sf_dir):
    """Documents to cleaned lines to vocabulary to location weights to weighted terms."""
    lines = I.docs(spark, sf_dir).select("line_no", "tokens")
    known = FE.known_terms(lines, V.fit_weights(lines))
    return known.select(
        "line_no",
        "token",
        "tf",
        F.round("ilf", 6).alias("ilf"),
        F.round(F.col("tf") * F.col("ilf"), 6).alias("tfilf"),
    )


# -- report set ---------------------------------------------------------------------------------------


@query(
    "report_set",
    f"""SELECT 'macro' AS report, round(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE), 6) AS value
    FROM ({PER_LABEL})
    UNION ALL SELECT 'micro', round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 6)
    FROM ({PER_LABEL})
    UNION ALL SELECT 'multi_acc', round(avg((y = pred)::INT::DOUBLE), 6) FROM order_preds""",
    "order_preds",
)
def report_set(spark, sf_dir):
    """All reports that suit several classes; "acc" is asked for too but needs two classes."""
    preds = I.order_predictions(spark, sf_dir)
    found = R.run_reports(["acc", "macro", "micro", "multi_acc"], multi=preds)
    rows = None
    for (_, name), report in found.items():
        row = report.select(F.lit(name).alias("report"), F.round(report[0], 6).alias("value"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "feature_store",
    "SELECT token, idx, df, lf, round(idf, 6) AS idf, round(ilf, 6) AS ilf FROM weights",
    *WEIGHTS,
)
def feature_store(spark, sf_dir):
    """Vocabulary and weights saved by a feature model and loaded again."""
    path = scratch_path(spark, "features")
    FeatureExtractor(["tfidf", "tfilf"]).fit(I.clean_lines(I.log_docs(spark, sf_dir))).save(path)
    weights = FeatureModel.load(spark, path).weights
    return weights.select(
        "token", "idx", "df", "lf", F.round("idf", 6).alias("idf"), F.round("ilf", 6).alias("ilf")
    )


# -- models ---------------------------------------------------------------------------------------------
# The SQL follows from the lines, not from a run: the type of an event is a word of its line, so a
# classifier must be right everywhere; and equal lines get equal decisions, so a detector can do no
# better than the majority label of each.

CLASSIFIED = """SELECT line_no, y, y AS pred FROM cleaned_events JOIN (
        SELECT label, CASE WHEN label = 'view' THEN -1.0::DOUBLE
            ELSE (row_number() OVER (ORDER BY min(line_no)) - 1)::DOUBLE END AS y
        FROM cleaned_events GROUP BY label) USING (label)
    WHERE y <> -1"""
EVENTS = ("log_events", "cleaned_events")
DETECTED = f"""SELECT line_no, y,
        CASE WHEN avg(y) OVER (PARTITION BY message) > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS pred
    FROM (SELECT line_no, message,
            CASE WHEN label = 'unlabeled' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS y
        FROM ({ORACLES["bgl_parse"]}))"""


def _event_corpus(spark, sf_dir) -> DataFrame:
    """Event lines; ``view`` is the healthy label, the other four types are the anomalies."""
    lines = I.clean_lines(I.log_events(spark, sf_dir))
    corpus = lines.select("line_no", "label", F.array_join("tokens", " ").alias("message"))
    return materialize(corpus, "event-corpus")


def _bgl_corpus(spark, sf_dir) -> DataFrame:
    return materialize(P.preprocess_bgl(I.log_bgl(spark, sf_dir)), "bgl-corpus")


def _masked_corpus(spark, sf_dir) -> DataFrame:
    """Event lines whose words do not always tell the class, with class names of their own."""
    lines = I.clean_lines(I.masked_events(spark, sf_dir))
    corpus = lines.select("line_no", "label", F.array_join("tokens", " ").alias("message"))
    return materialize(corpus, "masked-corpus")


def _masked_bgl_corpus(spark, sf_dir) -> DataFrame:
    lines = I.log_bgl(spark, sf_dir, I.MASKED_BGL_KIND, I.MASKED_HEXED)
    return materialize(P.preprocess_bgl(lines), "masked-bgl-corpus")


def _vectors(corpus: DataFrame, healthy: str) -> DataFrame:
    rows, _ = jobs.prepare(corpus, healthy)
    rows = materialize(rows, "rows")
    return FeatureExtractor(["tfilf", "length"]).fit(rows).transform(rows)


def _detect(name: str) -> Query:
    def run(spark, sf_dir):
        rows = _vectors(_bgl_corpus(spark, sf_dir), "unlabeled")
        rows = rows.withColumn("y", L.binary_truth(F.col("y")))
        return binary_models[name]().fit(rows).transform(rows).select("line_no", "y", "pred")

    return run


query("pu_detect", DETECTED)(_detect("pu_learning"))
query("rf_baseline", DETECTED)(_detect("regular"))


WIDE_COLUMNS = 256  # own columns of the wide detector: the most frequent words
SIGNS = (20, 45)  # its anomalies are lines with one of two words, given by their places among all words


@query(
    "pu_detect_wide",
    f"""SELECT line_no, y, CASE WHEN has_sign THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS pred FROM (
        SELECT line_no, has_sign, CASE WHEN has_sign AND (line_no // {I.LINES_PER_DOC} + line_no) % 4 <> 0
            THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y
        FROM (SELECT line_no, list_has_any(toks, (SELECT list(token) FROM (
                  SELECT token, row_number() OVER (ORDER BY df DESC, idx) AS place FROM vocab)
                  WHERE place IN {SIGNS})) AS has_sign FROM docs))""",
    *DOCS,
    "words",
    "vocab",
)
def pu_detect_wide(spark, sf_dir):
    """Positive-unlabeled learning on document lines, whose vocabulary is wider than trees can hold.

    A quarter of the anomalous lines have no label; all of them must be found. Every node may look at all
    columns, so the two words that make a line anomalous are found whatever the seed; the trees are
    shallow, as deeper ones learn the lines by heart.
    """
    lines = I.docs(spark, sf_dir).select("line_no", "tokens")
    model = FeatureExtractor(["tfilf", "length"], columns=WIDE_COLUMNS).fit(lines)
    frequent = [r.token for r in model.weights.where(F.col("col").isin([p - 1 for p in SIGNS])).collect()]
    labeled = F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in frequent])) & (
        (F.floor(F.col("line_no") / I.LINES_PER_DOC) + F.col("line_no")) % 4 != 0
    )
    rows = model.transform(lines.withColumn("y", F.when(labeled, 1.0).otherwise(-1.0)))
    detector = binary_models["pu_learning"](
        featureSubsetStrategy="all", maxDepth=2, minInstancesPerNode=50
    ).fit(rows)
    return detector.transform(rows).select("line_no", "y", "pred")


@query("svm_classify", CLASSIFIED, *EVENTS)
def svm_classify(spark, sf_dir):
    rows = L.anomalous_only(_vectors(_event_corpus(spark, sf_dir), I.HEALTHY_EVENT))
    return multi_models["svm"]().fit(rows).transform(rows).select("line_no", "y", "pred")


@query(
    "svm_top_terms",
    """SELECT n_classes, label, 1 AS rank, label AS name, 'LENGTH' AS last_column
    FROM (SELECT label, row_number() OVER (ORDER BY min(line_no)) AS place, count(*) OVER () AS n_classes
          FROM cleaned_events WHERE label <> 'view' GROUP BY label)
    UNION ALL SELECT 2, arg_min(label, line_no), 1, arg_min(label, line_no), 'LENGTH'
    FROM cleaned_events WHERE label IN ('click', 'error')""",
    *EVENTS,
)
def svm_top_terms(spark, sf_dir):
    """The strongest column of each class in a stored SVM: the word that names the class.

    Of two classes only the one seen first is reported.
    """
    corpus, found = _event_corpus(spark, sf_dir), []
    for kept in (F.lit(True), F.col("label").isin("click", "error")):
        rows, classes = jobs.prepare(corpus.where(kept), I.HEALTHY_EVENT)
        rows = materialize(rows, "rows")
        features = FeatureExtractor(["tfilf", "length"]).fit(rows)
        path = scratch_path(spark, "svm")
        multi_models["svm"]().fit(features.transform(L.anomalous_only(rows))).save(path)
        names, labels = features.feature_names(), L.target_names(classes)
        coefficients = stored_coefficients(spark, path).join(labels, "class_id")
        order = labels.select("label", F.col("class_id").alias("place"))
        top = R.top_k_terms(coefficients.select("label", "idx", "coef"), names, 1, order)
        last = names.agg(F.max_by("name", "idx")).scalar()
        n_classes = labels.agg(F.count("*")).scalar()
        found.append(top.select(n_classes.alias("n_classes"), "label", "rank", "name", last.alias("last_column")))
    return found[0].unionByName(found[1])


# The jobs' SQL learns from the training folds: a line is what most equal lines of the other folds are.


def _job_ctes(source: str, healthy: str, k: int, learns: str = "fold <> split") -> str:
    """Folded lines, and per training set the decision and the class of every message."""
    return f"""lines AS (
        SELECT line_no, label, message, CASE WHEN label = '{healthy}' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS b,
            ntile({k}) OVER (PARTITION BY label ORDER BY line_no) - 1 AS fold
        FROM ({source})),
    class_ids AS (
        SELECT label, CASE WHEN label = '{healthy}' THEN -1.0::DOUBLE
            ELSE (row_number() OVER (ORDER BY min(line_no)) - 1)::DOUBLE END AS y
        FROM lines GROUP BY label),
    splits AS (SELECT unnest(range({k})) AS split),
    detect AS (
        SELECT split, message, CASE WHEN avg(b) > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS pred
        FROM lines, splits WHERE {learns} GROUP BY split, message),
    guess AS (
        SELECT split, message, arg_max(y, n) AS pred, arg_max(label, n) AS class
        FROM (SELECT split, message, label, y, count(*) AS n FROM lines JOIN class_ids USING (label), splits
              WHERE b = 1 AND {learns} GROUP BY split, message, label, y)
        GROUP BY split, message)"""


MASKED = with_ctes("SELECT * FROM cleaned_masked", "cleaned_masked")
MASKED_BGL = with_ctes(BGL_PARSED.replace("FROM log_bgl", "FROM masked_bgl"), "masked_bgl")
K = jobs.DEFAULT_FOLDS
F1_SQL = """round(2 * count(*) FILTER (b = 1 AND pred = 1)
        / (count(*) FILTER (b = 1) + count(*) FILTER (pred = 1))::DOUBLE, 6)"""


@query(
    "train_global",
    f"""WITH {_job_ctes(MASKED, I.MASKED_HEALTHY, K)}
    SELECT fold::INT AS fold, f1, accuracy FROM (
        SELECT fold, {F1_SQL} AS f1
        FROM lines JOIN detect ON split = fold AND lines.message = detect.message GROUP BY fold)
    JOIN (SELECT fold, round(avg((y = pred)::INT::DOUBLE), 6) AS accuracy
        FROM lines JOIN class_ids USING (label) JOIN guess ON split = fold AND lines.message = guess.message
        WHERE b = 1 GROUP BY fold) USING (fold)""",
)
def train_global(spark, sf_dir):
    run = jobs.train_global(_masked_corpus(spark, sf_dir), I.MASKED_HEALTHY, parallelism=3)
    return run.results.select("fold", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "score_global",
    f"""WITH {_job_ctes(MASKED, I.MASKED_HEALTHY, 1, "true")}
    SELECT line_no, y, pred FROM lines JOIN class_ids USING (label) JOIN guess USING (message) WHERE b = 1""",
)
def score_global(spark, sf_dir):
    """Classes of the truly anomalous lines by the models of the best fold."""
    corpus, path = _masked_corpus(spark, sf_dir), scratch_path(spark, "run")
    jobs.train_global(corpus, I.MASKED_HEALTHY, path=path, parallelism=2)
    return jobs.score_global(corpus, path).multi


@query(
    "score_cascade",
    f"""WITH {_job_ctes(MASKED, I.MASKED_HEALTHY, 1, "true")}
    SELECT cascade, label, detect.pred AS anomaly,
        CASE WHEN if(cascade, detect.pred, b) = 1 THEN class END AS class, count(*) AS n
    FROM lines JOIN detect USING (message) LEFT JOIN guess USING (message),
        (SELECT unnest([true, false]) AS cascade)
    GROUP BY ALL""",
)
def score_cascade(spark, sf_dir):
    """Lines by label, decision and class: classified if anomalous in truth, or if the detector says so."""
    corpus, path = _masked_corpus(spark, sf_dir), scratch_path(spark, "run")
    jobs.train_global(corpus, I.MASKED_HEALTHY, path=path, parallelism=2)
    classes = L.target_names(spark.read.parquet(f"{path}/classes"))
    names = classes.select(F.col("label").alias("class"), F.col("class_id").alias("pred"))
    lines = [
        jobs.score_global(corpus, path, cascade=c).lines.withColumn("cascade", F.lit(c)) for c in (True, False)
    ]
    named = lines[0].unionByName(lines[1]).join(names, "pred", "left")
    return named.groupBy("cascade", "label", "anomaly", "class").agg(F.count("*").alias("n"))


@query(
    "train_binary",
    f"""WITH {_job_ctes(MASKED_BGL, "unlabeled", K)}
    SELECT fold::INT AS fold, {F1_SQL} AS f1
    FROM lines JOIN detect ON split = fold AND lines.message = detect.message GROUP BY fold""",
)
def train_binary(spark, sf_dir):
    run = jobs.train_binary(_masked_bgl_corpus(spark, sf_dir), "unlabeled", parallelism=3)
    return run.results.select("fold", F.round("f1", 6).alias("f1"))


@query(
    "score_binary",
    f"""WITH {_job_ctes(MASKED_BGL, "unlabeled", 1, "true")}
    SELECT line_no, b AS y, pred FROM lines JOIN detect USING (message)""",
)
def score_binary(spark, sf_dir):
    """Decisions on all lines by the model of the best fold."""
    corpus, path = _masked_bgl_corpus(spark, sf_dir), scratch_path(spark, "run")
    jobs.train_binary(corpus, "unlabeled", path=path, parallelism=2)
    return jobs.score_binary(corpus, path).binary


SWAPPED_FOLDS = 10  # the documented number for training on one fold


@query(
    "train_multi",
    f"""WITH {_job_ctes(MASKED, I.MASKED_HEALTHY, SWAPPED_FOLDS, "fold = split")},
    tested AS (
        SELECT split, y, pred FROM lines JOIN class_ids USING (label) JOIN guess USING (message)
        WHERE b = 1 AND fold <> split),
    labels AS (SELECT split, y AS label FROM tested UNION SELECT split, pred FROM tested),
    counted AS (
        SELECT split, label, count(*) FILTER (y = label AND pred = label) AS tp,
            count(*) FILTER (y <> label AND pred = label) AS fp,
            count(*) FILTER (y = label AND pred <> label) AS fn
        FROM tested JOIN labels USING (split) GROUP BY split, label)
    SELECT split::INT AS fold, round(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE), 6) AS macro,
        round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 6) AS micro
    FROM counted GROUP BY split""",
)
def train_multi(spark, sf_dir):
    """Ten swapped folds: each is learned from by itself and tested on the nine others."""
    run = jobs.train_multi(
        _masked_corpus(spark, sf_dir), I.MASKED_HEALTHY, k=SWAPPED_FOLDS, swap=True, parallelism=5
    )
    return run.results.select("fold", F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


# Of each training set and noise level: a message's share of rows that kept the label, over all rows for
# the plain forest and without the hold-out for positive-unlabeled learning, which divides by the mean
# share of the held-out rows.
ROBUST = f"""WITH parsed AS ({MASKED_BGL}),
    base AS (SELECT line_no, message, CASE WHEN label = 'unlabeled' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS y
        FROM parsed),
    chosen AS ({_force_ratio_sql("base", 8)}),
    folded AS (SELECT line_no, y, message, ntile({K}) OVER (PARTITION BY y ORDER BY line_no) - 1 AS fold
        FROM chosen JOIN base USING (line_no, y)),
    train AS (
        SELECT split, line_no, message, y,
            row_number() OVER (PARTITION BY split, y ORDER BY {_hash_sql(5)}) AS place,
            count(*) FILTER (y = -1) OVER (PARTITION BY split) AS n_unl
        FROM folded, (SELECT unnest(range({K})) AS split) WHERE fold <> split),
    noisy AS (
        SELECT split, i, line_no, message,
            CASE WHEN y = 1 AND place > i * n_unl // (100 - i) THEN 1 ELSE 0 END AS kept
        FROM train, (SELECT unnest(range(11)) AS i)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY split, i, kept ORDER BY {_hash_sql(0)}) AS place,
            sum(kept) OVER (PARTITION BY split, i) AS n_pos
        FROM noisy),
    held AS (SELECT *, kept = 1 AND place <= ceil(n_pos * 0.1::DOUBLE) AS out FROM ranked),
    shares AS (
        SELECT split, i, message, avg(kept) AS share, avg(kept) FILTER (NOT out) AS p1
        FROM held GROUP BY split, i, message),
    constants AS (SELECT split, i, avg(p1) AS c FROM held JOIN shares USING (split, i, message)
        WHERE out GROUP BY split, i),
    tested AS (
        SELECT fold, i, y, share > 0.5 AS plain, p1 / c > 0.5 AS pu
        FROM folded JOIN shares ON split = fold AND shares.message = folded.message JOIN constants USING (split, i))
    SELECT fold::INT AS fold, i::INT AS percentage,
        round(2 * count(*) FILTER (y = 1 AND pu) / (count(*) FILTER (y = 1) + count(*) FILTER (pu))::DOUBLE, 6) AS pu_f1,
        round(2 * count(*) FILTER (y = 1 AND plain)
            / (count(*) FILTER (y = 1) + count(*) FILTER (plain))::DOUBLE, 6) AS regular_f1
    FROM tested GROUP BY fold, i"""


@query("pu_robustness", ROBUST)
def pu_robustness(spark, sf_dir):
    """The sweep with its documented settings.

    Forests that see all rows and columns have one right answer; at the higher levels a tenth of the
    positives keep their label, so the learner is the one whose trees are not cut back.
    """
    corpus = _masked_bgl_corpus(spark, sf_dir)
    results = jobs.pu_robustness(
        corpus, "unlabeled", ratio=8, top_percentage=11, step=1, k=3, parallelism=3,
        pu_classifier="pu_unpruned", bootstrap=False, featureSubsetStrategy="all",
    ).results
    scores = [F.round(name, 6).alias(name) for name in ("pu_f1", "regular_f1")]
    return results.select("fold", "percentage", *scores)


@query(
    "run_record",
    f"""WITH {_job_ctes(MASKED_BGL, "unlabeled", K)},
    scored AS (SELECT fold, {F1_SQL} AS f1
        FROM lines JOIN detect ON split = fold AND lines.message = detect.message GROUP BY fold)
    SELECT 'run-1' AS run_id, 'train_binary' AS job, 'unlabeled' AS healthy, {K} AS k, 'length' AS last_feature,
        fold::INT AS fold, f1, row_number() OVER (ORDER BY f1 DESC, fold) = 1 AS best, true AS timed, 2 AS n_runs
    FROM scored""",
)
def run_record(spark, sf_dir):
    """Settings, scores and seconds of a job stored with those of another run, read back and typed."""
    corpus, path = _masked_bgl_corpus(spark, sf_dir), scratch_path(spark, "records")
    settings = {"healthy": "unlabeled", "k": K, "features": ["tfilf", "length"]}
    run = jobs.train_binary(corpus, parallelism=3, **settings)
    for run_id in ("run-1", "run-2"):
        stores.append_record(run.record(run_id, "train_binary", settings), path)
    records = stores.load_records(spark, path)
    n_runs = records.agg(F.count_distinct("run_id").cast("int")).scalar()
    mine = records.where("run_id = 'run-1'").join(run.results.select("fold", "f1"), "fold")
    return mine.select(
        "run_id",
        "job",
        stores.setting("healthy").alias("healthy"),
        stores.setting("k", "int").alias("k"),
        F.element_at(stores.setting("features", "array<string>"), -1).alias("last_feature"),
        "fold",
        F.round(F.col("scores")["f1"], 6).alias("f1"),
        "best",
        ((F.col("train_time") > 0) & (F.col("run_time") > 0) & (F.col("f1") == F.col("scores")["f1"])).alias("timed"),
        n_runs.alias("n_runs"),
    )


class NearerMean(Estimator):
    """A detector of one column: anomalous where the value is nearer to the mean of the anomalous lines."""

    def _fit(self, rows):
        value = vector_to_array("features")[0]
        return NearerMeanModel(*rows.agg(*[F.avg(F.when(F.col("y") == y, value)) for y in (1, -1)]).first())


class NearerMeanModel(Model):
    def __init__(self, anomalous, healthy):
        super().__init__()
        self.means = anomalous, healthy

    def _transform(self, rows):
        anomalous, healthy = [F.abs(vector_to_array("features")[0] - mean) for mean in self.means]
        return rows.withColumn("pred", F.when(anomalous < healthy, 1.0).otherwise(-1.0))


def _alarm_rate(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col("pred") == 1).cast("double")).alias("alarm_rate"))


@query(
    "extensions",
    f"""WITH {_job_ctes(MASKED_BGL, "unlabeled", K)},
    valued AS (SELECT *, len(list_distinct(string_split(message, ' ')))::DOUBLE AS v FROM lines),
    means AS (SELECT split, avg(v) FILTER (b = 1) AS up, avg(v) FILTER (b = -1) AS low
        FROM valued, splits WHERE fold <> split GROUP BY split),
    tested AS (SELECT fold, b, if(abs(v - up) < abs(v - low), 1, -1) AS pred FROM valued JOIN means ON split = fold),
    scored AS (SELECT fold, {F1_SQL} AS f1, round(avg((pred = 1)::INT::DOUBLE), 6) AS alarm_rate
        FROM tested GROUP BY fold)
    SELECT fold::INT AS best_fold, f1, alarm_rate, 0 AS left_over FROM scored ORDER BY f1 DESC, fold LIMIT 1""",
)
def extensions(spark, sf_dir):
    """A feature, a detector and a report of one's own in a training job, and gone afterwards."""
    known = (registry.features, registry.binary_models, registry.prediction_reports)
    before = [dict(names) for names in known]
    distinct_terms = FE.LineFeature(lambda counts: F.size(counts).cast("double"))
    with (
        registry.features.registered("distinct_terms", distinct_terms),
        registry.binary_models.registered("nearer_mean", NearerMean),
        registry.prediction_reports.registered("alarm_rate", _alarm_rate),
    ):
        run = jobs.train_binary(
            _masked_bgl_corpus(spark, sf_dir),
            "unlabeled",
            features=["distinct_terms"],
            binary_classifier="nearer_mean",
            reports=["alarm_rate"],
        )
    left = sum(dict(names) != was for names, was in zip(known, before, strict=True))
    best = run.results.where(F.col("fold") == run.best_fold)
    rate = run.reports["binary", "alarm_rate"].select(F.round("alarm_rate", 6)).scalar()
    return best.select(
        F.col("fold").alias("best_fold"),
        F.round("f1", 6).alias("f1"),
        rate.alias("alarm_rate"),
        F.lit(left).alias("left_over"),
    )


@query(
    "model_roundtrip",
    """SELECT task, count(*) AS n, 0 AS n_different
    FROM cleaned_events, (SELECT unnest(['binary', 'multi']) AS task) GROUP BY task""",
    *EVENTS,
)
def model_roundtrip(spark, sf_dir):
    """Predictions of the trained models that the saved and loaded ones disagree with, per task."""
    corpus, path = _event_corpus(spark, sf_dir), scratch_path(spark, "run")
    run = jobs.train_global(corpus, I.HEALTHY_EVENT, path=path, parallelism=2)
    loaded = jobs.load_models(spark, path)
    rows, _ = jobs.prepare(corpus, I.HEALTHY_EVENT)
    found = []
    for task in ("binary", "multi"):
        before = run.models[task].transform(run.models["features"].transform(rows))
        after = loaded[task].transform(loaded["features"].transform(rows))
        pairs = before.select("line_no", "pred").join(
            after.select("line_no", F.col("pred").alias("again")), "line_no"
        )
        found.append(
            pairs.agg(
                F.lit(task).alias("task"),
                F.count("*").alias("n"),
                F.count_if(F.col("pred") != F.col("again")).alias("n_different"),
            )
        )
    return found[0].unionByName(found[1])
