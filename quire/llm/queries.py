"""Registered queries of the operators: thin calls on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import bpe_round_trip
from quire.llm.common import apply_llm_conf, shared_path, table, word_count
from quire.llm.embeddings import embedding_near_duplicates
from quire.llm.licenses import scan_licenses
from quire.llm.mixing import mix_sources, quality_weights
from quire.llm.prefix_trie import conversation_trie
from quire.llm.quality import classify_quality
from quire.llm.repair import repair_damaged
from quire.llm.sharding import shard_by_bytes
from quire.llm.simhash import simhash_near_duplicates
from quire.llm.syncmers import fingerprints_with_next
from quire.llm.trie_bpe import trie_round_trip
from quire.llm.urls import judge_urls
from quire.llm.warc import read_archives, write_archives

#: Fixed values of the URL filter's contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every whole text, its edited text and the next document."""
    found = fingerprints_with_next(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 3-word shingles, at most 3 differing bits."""
    found = simhash_near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every whole text by the multi-language 50k ranks."""
    import public_tokenizers

    found = bpe_round_trip(table(spark, sf_dir, "documents"), "doc_id", "text",
                           public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licenses that a whole document, or a line of it, is."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "text_digest", "text_license", F.array_join("line_licenses", ",").alias("line_licenses"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 16 shards; the law is ``bytes``."""
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: weights 5, 2, 1 by source, at most 3 times a source; documents
    rated good are preferred within their source."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), "doc_id", "source", word_count(F.col("text")),
                        ratings=quality_weights(table(spark, sf_dir, "labels")), weights=(5, 2, 1), max_times=3)
    return mixed.select(F.col("id").alias("doc_id"), "size", F.col("mix.source_size").alias("source_size"),
                        F.col("mix.target").alias("target"), F.col("mix.taken").alias("taken"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade (0 poor, 1 toxic, 2 good) and selection of every document."""
    scored = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return scored.select("doc_id", score["expected_grade"].alias("expected_grade"), score["tails"][0].alias("p_not_poor"),
                         score["tails"][1].alias("p_good"), score["keep"].alias("keep"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rules; a page is labelled by the ratings of the document whose
    id is the last number of its path: good is quality 1 and not toxic."""
    labels = table(spark, sf_dir, "labels")
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.min("quality") - F.max(F.coalesce("toxic", F.lit(0))) > 0).alias("good"))
    number = F.expr("try_cast(regexp_extract(regexp_extract(url, '^[^?#]*', 0), '([0-9]+)[^0-9]*$', 1) AS bigint)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", number.alias("doc_id")).join(rated, "doc_id", "left")
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return judge_urls(pages, "page_id", "url", rules, F.col("good")).withColumnRenamed("id", "page_id")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: cosine of at least 0.9."""
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9).withColumnRenamed("id", "vec_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: a record per page, written to archives in the shared folder
    and read back; equal payloads of any size are revisits."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return read_archives(spark, path).select(
        F.expr("try_cast(key AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every whole text by the 50k file of the tokenizers library."""
    import public_tokenizers

    found = trie_round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: the cheapest repair of every damaged conversation."""
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = [op1_closed_syncmers, op2_simhash_near_dedup, op3_byte_bpe, op4_license_scan, op5_sharding, op6_source_mixing,
           op7_quality_classifier, op8_url_filter, op9_embedding_near_dedup, op10_warc, op11_prefix_trie, op12_trie_bpe,
           op13_structure_repair]


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_llm_conf(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        return run
    return {fn.__name__: prepared(fn) for fn in QUERIES}
