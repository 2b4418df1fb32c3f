"""Deterministic source collections derived from the ``documents`` table.

The flat projection below is plain SQL that runs unchanged in Spark and in
DuckDB (the oracle reuses the same text). ``stats_source`` / ``crossref_source``
nest it into the two source schemas the engine ingests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.schema import CROSSREF_SCHEMA, STATS_SCHEMA

# The flat fixture projection over ``documents``.
FLAT_SOURCE_SQL = """
SELECT doc_id,
  concat('p', lpad(cast(doc_id AS string), 8, '0')) AS id,
  CASE WHEN doc_id % 97 = 5 THEN cast('NaN' AS double) WHEN doc_id % 101 = 6 THEN cast('Infinity' AS double)
       WHEN doc_id % 89 = 7 THEN NULL ELSE cast(doc_id * 37 % 1000 AS double) / 10e0 END AS hot_raw,
  cast(doc_id * 53 % 1000 AS double) / 10e0 AS hot6m_raw,
  cast(doc_id * 7919 % 10007 AS double) / 10007e0 AS pagerank_raw,
  doc_id % 4 AS n_topics,
  CASE WHEN doc_id % 31 = 3 THEN NULL ELSE 1990 + doc_id % 40 END AS pub_year,
  CASE WHEN doc_id % 83 = 9 THEN 13 WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + doc_id % 12 END AS pub_month,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 + doc_id % 28 END AS pub_day,
  CASE WHEN doc_id % 43 = 4 THEN NULL
       ELSE concat('<jats:title>', split_part(split_part(text, chr(10), 1), '. ', 1), ' &amp; r&lt;d&gt;</jats:title>') END AS title_raw,
  CASE WHEN doc_id % 11 = 4 OR doc_id % 43 = 4 AND doc_id % 2 = 0 THEN ''
       ELSE concat('<jats:p>Abstract ', text, '</jats:p>') END AS abstract_raw,
  CASE WHEN doc_id % 17 = 2 THEN NULL ELSE concat('Journal of ', source) END AS journal_raw,
  concat('Publisher ', lang) AS publisher_raw,
  concat('Given', cast(doc_id % 50 AS string)) AS given_1, concat('Family', cast(doc_id % 20 AS string)) AS family_1,
  CASE WHEN doc_id % 6 = 1 THEN '' ELSE 'Co' END AS given_2,
  CASE WHEN doc_id % 6 = 1 THEN '' ELSE concat('Author', cast(doc_id % 9 AS string)) END AS family_2,
  CASE WHEN doc_id % 7 = 1 THEN NULL ELSE concat('10.5555/', cast(doc_id AS string)) END AS doi_raw,
  cast(doc_id % 250 AS int) AS citations_raw,
  doc_id % 50 <> 7 AS has_crossref
FROM {documents}
"""

# Topic vocabulary of the fixtures, in order.
TOPIC_NAMES = ["machine learning", "ensemble", "microfinance", "artificial-intelligence",
               "neural networks", "data mining"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flat_sources(spark: SparkSession, documents: DataFrame) -> DataFrame:
    # Only doc_id/text/lang/source are referenced, so the scan is pruned to them.
    docs = documents.select("doc_id", "text", "lang", "source")
    return spark.sql(FLAT_SOURCE_SQL, documents=docs)


def _topics(flat: DataFrame) -> F.Column:
    names = F.array(*[F.lit(n) for n in TOPIC_NAMES])
    d = F.col("doc_id")

    def one(i):
        hot = F.when((d + i) % 13 == 0, F.lit(None).cast("double")).otherwise(((d * (i + 7)) % 1000) / F.lit(10.0))
        return F.struct(
            F.get(names, ((d + i) % 6).cast("int")).alias("name"),
            (((d * (i + 3)) % 100) / F.lit(100.0)).alias("relevanceScore"),
            (((d * (i + 5)) % 1000) / F.lit(10.0)).alias("topScore"),
            hot.alias("hotScore"),
            (hot / 2).alias("hotScore_6m"),
        )

    return F.when(F.col("n_topics") == 0, F.array().cast(STATS_SCHEMA["topicRelatedScores"].dataType)).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_topics") - 1), one)
    )


def stats_source(flat: DataFrame) -> DataFrame:
    """``publicationStatistics`` rows (one per document)."""
    return flat.select(
        F.col("id").alias("_id"),
        F.col("hot_raw").alias("publicationHotScore"),
        F.col("hot6m_raw").alias("publicationHotScore_6m"),
        F.col("pagerank_raw").alias("pageRank"),
        _topics(flat).alias("topicRelatedScores"),
    ).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in STATS_SCHEMA.fields])


def crossref_source(flat: DataFrame) -> DataFrame:
    """``crossref_raw_data`` rows (missing for some ids)."""
    author = lambda g, f, seq: F.struct(F.col(g).alias("given"), F.col(f).alias("family"),
                                        F.lit(None).cast("string").alias("ORCID"), F.lit(seq).alias("sequence"))
    raw = F.struct(
        F.when(F.col("title_raw").isNotNull(), F.array("title_raw")).alias("title"),
        F.col("abstract_raw").alias("abstract"),
        F.when(F.col("journal_raw").isNotNull(), F.array("journal_raw")).alias("container-title"),
        F.col("publisher_raw").alias("publisher"),
        F.array(author("given_1", "family_1", "first"), author("given_2", "family_2", "additional")).alias("author"),
        F.col("doi_raw").alias("DOI"),
        F.col("citations_raw").alias("is-referenced-by-count"),
    )
    pub = F.struct(F.col("pub_year").cast("int").alias("year"), F.col("pub_month").cast("int").alias("month"),
                   F.col("pub_day").cast("int").alias("day"))
    out = flat.where("has_crossref").select(F.col("id").alias("_id"), pub.alias("publishedAt"), raw.alias("raw_data"))
    return out.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in CROSSREF_SCHEMA.fields])


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    flat = flat_sources(spark, read_table(spark, sf_dir, "documents"))
    return stats_source(flat), crossref_source(flat)


def vectors_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precomputed embeddings keyed by paper id (``vec_id`` = ``doc_id``)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.concat(F.lit("p"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"),
                      F.col("embedding").alias("embeddingVector"))
