"""The registered queries of the subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from logsift.llm import (
    chat,
    compression_quality,
    decontaminate,
    golay_dedup,
    katz,
    mixing,
    norm_bounds,
    pii,
    prefix_forest,
    secret_owners,
    token_files,
    toxicity_fm,
    whitening,
)
from logsift.llm.common import id_remainder, table
from logsift.llm.sql import ORACLES as _SQL
from logsift.sources.scratch import materialize, scratch_path

TOKENIZER = "byte_bpe_50k.json"


def op1_prefix_forest(spark, sf_dir):
    """Five nearest neighbours of every fiftieth vector."""
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0)


def op2_mixing(spark, sf_dir):
    """Documents mixed to weights 1, 2, 3 of their sources."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_golay(spark, sf_dir):
    """SimHash fingerprint and near-duplicate group of every document."""
    found = golay_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_decontamination(spark, sf_dir):
    """Benchmark windows found in every document."""
    marked = decontaminate.mark_contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    n_hit = decontaminate.hit_words(F.col("hits.spans"))
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("hits.items")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_chat_formatting(spark, sf_dir):
    """All conversations formatted, then read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    more = turns.sparkSession.sql(
        f"SELECT -1L conv_id, stack(2, 0L, 'user', '{tricky}', 1L, 'assistant', '{tricky}') AS (turn, role, text)"
    )
    messages = turns.unionByName(more).withColumn("parts", chat.text_part(F.col("text")))
    formatted = chat.format_conversations(messages).withColumn("turns", chat.read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(said).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_compression_quality(spark, sf_dir):
    """Quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression_quality.train(docs, labels)
    return _decided(docs, model, compression_quality.HELD_OUT, compression_quality.THRESHOLD)


def op7_token_files(spark, sf_dir):
    """Token files written, and every document read back from them."""
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.read_tokens(spark, path)


def op8_toxicity_fm(spark, sf_dir):
    """Toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_fm.train(docs, labels)
    return _decided(docs, model, toxicity_fm.HELD_OUT, toxicity_fm.THRESHOLD)


def _decided(docs, model, held_out, threshold):
    scored = compression_quality.score(docs, model, ["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        (id_remainder(F.col("row.doc_id"), held_out[0]) == held_out[1]).alias("held_out"),
        F.col("value").alias("score"),
        (F.col("value") >= threshold).cast("int").alias("predicted"),
    )


def op9_katz_backoff(spark, sf_dir):
    """Katz backoff score of every document."""
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    """Personal data in every document."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.spans_text(F.concat("base", "added")).alias("spans"),
    )


def op11_secret_owners(spark, sf_dir):
    """Secrets in every document, judged by how many owners have them."""
    found = secret_owners.secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(secret_owners.KINDS)],
        F.sha2(secret_owners.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_owners.spans_text(F.concat("base", "added")).alias("spans"),
        secret_owners.spans_text(F.col("owned")).alias("owned_spans"),
        secret_owners.spans_text(F.col("copied")).alias("copied_spans"),
    )


def op12_whitening(spark, sf_dir):
    """Every vector on the first eight whitened components."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("row.vec_id").alias("vec_id"),
        "component",
        "n",
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


def op13_norm_bounds(spark, sf_dir):
    """Codes of every vector, their errors, and the final codebooks."""
    made = norm_bounds.compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    digests = {length: norm_bounds.codebook_digest(book) for length, book in made.codebooks.items()}
    digest = F.create_map(*[F.lit(x) for pair in digests.items() for x in pair])[F.col("length")]
    errors = made.rows.groupBy(F.col("row.label").alias("of")).agg(F.sum("error").alias("label_error"))
    errors = materialize(errors, "label-errors")
    return made.rows.join(errors, F.col("row.label").eqNullSafe(F.col("of"))).select(
        F.col("row.vec_id").alias("vec_id"),
        norm_bounds.code_text(F.col("code")).alias("code"),
        "error",
        "label_error",
        digest.alias("codebooks_sha256"),
    )


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_forest,
        op2_mixing,
        op3_simhash_golay,
        op4_decontamination,
        op5_chat_formatting,
        op6_compression_quality,
        op7_token_files,
        op8_toxicity_fm,
        op9_katz_backoff,
        op10_pii,
        op11_secret_owners,
        op12_whitening,
        op13_norm_bounds,
        pipeline,
    )
}
ORACLES = {name: sql for name, sql in _SQL.items() if sql} | (
    {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
)
