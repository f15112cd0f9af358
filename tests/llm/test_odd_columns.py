"""Column names that need quoting, and repeated ids under the labels of a training sample."""

import pytest
from pyspark.sql import functions as F

from logsift.llm import compression_quality, decontaminate, golay_dedup, mixing, toxicity_fm
from logsift.llm.compression_quality import labelled_sample, texts_of

ODD = ["my col", "a.b", "c`d", "e:f", "row", "hits", "_", "kept", "value", "größe"]
GOOD, BAD = "a clear sentence about the sea and ships", "zzz buy now click xx !!"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{GOOD if i % 2 else BAD} {i}", f"s{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in ODD])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")


def same_columns(after, docs):
    rows = [r.asDict() for r in after.collect()]
    assert after.columns == docs.columns
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in ODD)
    return {r["doc_id"] for r in rows}


def test_odd_column_names(spark, docs, labels):
    benchmark = spark.createDataFrame([(1, f"{GOOD} 7")], "item_id long, text string")
    assert same_columns(decontaminate.drop_contaminated(docs, benchmark), docs) == set(range(60)) - {7}
    cut = decontaminate.remove_spans(docs, benchmark)
    assert same_columns(cut, docs) == set(range(60)) and cut.where("doc_id = 7").first().text == ""
    assert same_columns(compression_quality.keep_good(docs, labels), docs) <= set(range(60))
    assert len(same_columns(golay_dedup.keep_first(docs), docs)) > 0
    mixed = mixing.mix(docs, keep=docs.columns).select("kept.*")
    assert same_columns(mixed, docs) == set(range(60))


def test_operators_on_renamed_columns(spark, docs):
    renamed = docs.select(F.col("doc_id").alias("the id"), F.col("text").alias("te.xt"), F.col("source").alias("so`urce"))
    mixed = mixing.mix(renamed, id_col="the id", source_col="so`urce", text_col="te.xt")
    assert mixed.count() == 60
    assert golay_dedup.near_duplicates(renamed, id_col="the id", text_col="te.xt").count() == 60


def test_one_text_of_a_repeated_id(spark, docs, labels):
    """A third of all rows under one id: the sample stays bounded and the models can still be trained."""
    more = docs.select("doc_id", "text").unionByName(
        spark.range(3000).select(F.lit(4).cast("long").alias("doc_id"), F.concat(F.lit("copy "), "id").alias("text"))
    )
    sample = labelled_sample(labels, "doc_id", "quality", F.lit(True), 10)
    texts = texts_of(more, sample, "doc_id", "text").collect()
    assert len(texts) == sample.count() == 20 and len({r[0] for r in texts}) == 20
    again = texts_of(more.repartition(7), sample, "doc_id", "text").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, texts))
    for module in (compression_quality, toxicity_fm):
        assert module.train(more, labels) is not None
