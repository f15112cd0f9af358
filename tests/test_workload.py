"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import inspect
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from logsift.plans import jobs
from workload import queries

SF_DIR = "/root/testdata/sf0.001"
NAMES = (
    "weighted_terms clean_parameters bgl_parse paired_join ngrams_3 label_encode vectorize_oov "
    "feature_test_fold minmax_scale stratified_kfold force_ratio label_noise pu_decide f1_macro "
    "confusion top_k_terms best_fold corpus_text paired_files feature_vectors train_binary extensions"
).split()

needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    result = duck.execute(driver.oracle_sql()[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == columns
    expected = [tuple(row[have.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert got


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@needs_data
def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["line_no", "token", "tf", "ilf", "tfilf"]


@pytest.mark.parametrize(
    "name, job, documented",
    [
        ("pu_robustness", "pu_robustness", {"ratio": 8, "top_percentage": 11, "step": 1, "k": 3}),
        ("train_multi", "train_multi", {"k": 10, "swap": True}),
        ("score_global", "train_global", {"k": jobs.DEFAULT_FOLDS}),
        ("score_cascade", "train_global", {"k": jobs.DEFAULT_FOLDS}),
        ("score_binary", "train_binary", {"k": jobs.DEFAULT_FOLDS}),
        ("model_roundtrip", "train_global", {"k": jobs.DEFAULT_FOLDS}),
    ],
)
def test_jobs_run_with_documented_settings(monkeypatch, name, job, documented):
    class Called(Exception):
        pass

    signature, seen = inspect.signature(getattr(jobs, job)), {}

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(jobs, job, record)
    for maker in ("_event_corpus", "_masked_corpus", "_masked_bgl_corpus", "scratch_path"):
        monkeypatch.setattr(queries, maker, lambda *_: None)
    with pytest.raises(Called):
        getattr(queries, name)(None, None)
    assert {k: seen[k] for k in documented} == documented


@pytest.mark.parametrize("missing", ["logsift.llm", "logsift.llm.registered", "corpus_pipeline", "zstandard"])
def test_other_queries_survive_a_missing_module(monkeypatch, missing):
    for name in [m for m in sys.modules if m.startswith(("logsift.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # importing it now raises ImportError
    if missing == "logsift.llm":
        monkeypatch.delattr(sys.modules["logsift"], "llm", raising=False)
    with pytest.warns(UserWarning, match="no training-data queries"):
        assert set(driver.queries()) == set(queries.QUERIES)
    with pytest.warns(UserWarning):
        assert set(driver.oracle_sql()) == set(queries.ORACLES)
