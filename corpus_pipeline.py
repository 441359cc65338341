"""Corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of documents (the last: packed pieces).  ``run`` writes every
stage as Parquet into the shared checkpoint folder and reads it back for the next.

Null and empty texts fail the base rule and go in the first stage; a null source takes the mean host
rate.  Repeated rows pass the first two stages alike, and near-dedup keeps one of them.  Rows with a null id
are rows like any other.  Empty tables give empty results, and columns beside those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import packing, pii, quality_model, quality_rules, simhash
from tidewater.llm.queries import END_ID, SEQUENCE_TOKENS, SIMHASH_BITS, SIMHASH_WORDS, tokenizer_path
from tidewater.session import scratch_path


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    return quality_rules.keep_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents predicted 0 go.

    The model is fitted to the labelled rows of the whole documents table, since the
    rules have already taken most rejected texts from ``docs``; it scores ``docs``.
    """
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = quality_model.train(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_good(docs, weights)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of linked documents the one with the least doc_id stays."""
    return simhash.keep_one(docs, SIMHASH_WORDS, SIMHASH_BITS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span is replaced by its kind; n_chars follows the new text."""
    return pii.mask_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of every document with their place in the training sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), SEQUENCE_TOKENS, END_ID)


STAGES = [("quality_rules", rules_stage), ("quality_classifier", classifier_stage), ("simhash_near_dedup", dedup_stage),
          ("pii", pii_stage), ("packing", packing_stage)]

# The classifier, the linking and the packing have no SQL form; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, "corpus-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
