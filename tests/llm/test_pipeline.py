"""The pipeline's stages and the registered queries on the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logsift.llm import golay_dedup, registered

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, made = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF_DIR).cache()
        made.append((before, docs))
    return made


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_filters_only_remove(stages):
    for before, after in stages[:3]:
        assert after.exceptAll(before).count() == 0
        assert 0 < after.count() <= before.count()


def test_near_dedup_keeps_one_of_each_group(stages):
    """The groups are those of the operator's own fingerprints and distance."""
    before, after = stages[1]
    groups = golay_dedup.near_duplicates(before).groupBy("component_id").agg(F.min("doc_id").alias("doc_id"))
    assert sorted(r.doc_id for r in groups.collect()) == sorted(r.doc_id for r in after.collect())


def test_mix_takes_near_the_targets(stages):
    before, after = stages[3]
    assert after.distinct().exceptAll(before.distinct()).count() == 0
    size = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert size(after) == pytest.approx(size(before), rel=0.2)


def test_token_files_hold_the_mix(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages[4]
    expected = []
    for r in before.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after.collect()) == sorted(expected)


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = registered.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = con.execute(registered.ORACLES[name])
    have = [d[0] for d in result.description]
    expected = [tuple(row[have.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(expected)


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in registered.QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
