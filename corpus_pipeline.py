"""From documents to token files: quality, near-duplicates, decontamination, mixing, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import compression_quality, decontaminate, golay_dedup, mixing, token_files
from logsift.llm.common import table
from logsift.sources.scratch import materialize, scratch_path

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return compression_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, with the operator's own shingles and distance."""
    return golay_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs, keep=docs.columns).filter("copies > 0")
    copies = mixed.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "kept")
    return copies.select("kept.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per document and copy."""
    path = scratch_path(spark, "pipeline-tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path(TOKENIZER))
    return token_files.read_tokens(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", tokens),
]

#: The classifier and the tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, f"stage{at + 1}")
    return docs
