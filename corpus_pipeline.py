"""Corpus pipeline: stages over ``documents``, each written as Parquet and
reread as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``. Null texts pass every stage as texts
without words; an empty table gives empty results; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import bpe_encode
from quire.llm.common import apply_llm_conf, cut_lineage, table, word_count
from quire.llm.mixing import mixed_copies, quality_weights
from quire.llm.quality import classify_quality
from quire.llm.simhash import keep_one_per_component


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the
    ratings in ``labels``."""
    apply_llm_conf(spark)
    scored = classify_quality(docs, table(spark, sf_dir, "labels"), column="__quality")
    return scored.where(F.col("__quality.keep")).drop("__quality")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the
    smallest doc_id."""
    apply_llm_conf(spark)
    return keep_one_per_component(docs, words_per_shingle=3, max_bits=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the mix's proportions: whole documents, as often as it takes
    them (not at all, or up to 3 times)."""
    apply_llm_conf(spark)
    return mixed_copies(docs, "doc_id", "source", word_count(F.col("text")),
                        ratings=quality_weights(table(spark, sf_dir, "labels")), weights=(5, 2, 1), max_times=3)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts: the columns of documents but the text, and
    ``ids`` and ``n_tokens``."""
    import public_tokenizers

    apply_llm_conf(spark)
    encoded = bpe_encode(docs, "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids_col="ids")
    return encoded.drop("text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: The classifier and the byte-pair encoding can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
