"""Shared building blocks of the registered query plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.mapping import CONTENT_COLUMNS, contextual_content, map_joined, join_sources, map_papers
from quire.schema import papers_schema
from quire.session import dropping_shuffles, shared_path
from quire.sources.fixtures import read_table, sources, vectors_source

AS_OF = "2024-12-31"
TEST_DIM = 64


def papers_and_rejects(spark: SparkSession, sf_dir: str, with_vectors: bool = True):
    stats, cr = sources(spark, sf_dir)
    vectors = vectors_source(spark, sf_dir) if with_vectors else None
    return map_papers(stats, cr, vectors, dim=TEST_DIM)


_PUBLISHED: dict[tuple, str] = {}


def snapshot_key(p: DataFrame) -> tuple:
    """Names the published snapshot that ``papers`` returned."""
    return p._snapshot_key


def _with_content(stored: DataFrame) -> DataFrame:
    whole = stored.withColumn("contextualContent", contextual_content(*map(F.col, CONTENT_COLUMNS)))
    return whole.select(*papers_schema(TEST_DIM).names)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published ``papers`` snapshot of a source folder (with vectors).

    Like the sync job would, it is built once per session from the driver
    tables and written to the shared checkpoint folder; every later plan in
    the session reads that snapshot (and its one text index) instead of
    re-running the ingest. Plans that do not touch ``embeddingVector`` never
    read it (column pruning). ``contextualContent`` repeats texts that are
    stored beside it, so it is made of them where it is read.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    path = _PUBLISHED.get(key)
    found = None
    if path is not None:
        try:
            found = _with_content(spark.read.parquet(path))
        except Exception:  # snapshot folder cleaned up: rebuild
            _PUBLISHED.pop(key, None)
    if found is None:
        path = shared_path(spark, "published", "papers")
        with dropping_shuffles(spark):
            papers_and_rejects(spark, sf_dir)[0].drop("contextualContent").write.mode("overwrite").parquet(path)
        _PUBLISHED[key] = path
        found = _with_content(spark.read.parquet(path))
    found._snapshot_key = (*key, path)
    return found


def mapped_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stats row after the join and mapping, with its reject reason."""
    stats, cr = sources(spark, sf_dir)
    return map_joined(join_sources(stats, cr))


def names_of(arr: str, field: str, sep: str) -> Column:
    return F.array_join(F.transform(F.col(arr), lambda x: x[field]), sep)


def flat_paper(df: DataFrame, *extra) -> DataFrame:
    """Flat, engine-neutral projection of paper rows (arrays joined to strings)."""
    return df.select(
        "id", "title", "journal",
        names_of("authors", "name", "; ").alias("author_names"),
        names_of("topics", "name", ", ").alias("topic_names"),
        F.col("publishedAt").cast("string").alias("published_at"),
        "publicationHotScore", "pageRank", F.col("citationsCount").cast("long").alias("citationsCount"),
        "hasAbstract", *extra)


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text request per benchmark item: its whole text."""
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
