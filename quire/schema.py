"""Explicit schemas: the two source collections and the ``papers`` table."""

from __future__ import annotations

from pyspark.sql import types as T

DEFAULT_DIM = 768

TOPIC_SCORE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("relevanceScore", T.DoubleType()),
    T.StructField("topScore", T.DoubleType()),
    T.StructField("hotScore", T.DoubleType()),
    T.StructField("hotScore_6m", T.DoubleType()),
])

# publicationStatistics: one row per paper with precomputed scores.
STATS_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType(), False),
    T.StructField("publicationHotScore", T.DoubleType()),
    T.StructField("publicationHotScore_6m", T.DoubleType()),
    T.StructField("pageRank", T.DoubleType()),
    T.StructField("topicRelatedScores", T.ArrayType(TOPIC_SCORE)),
])

AUTHOR_RAW = T.StructType([
    T.StructField("given", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("ORCID", T.StringType()),
    T.StructField("sequence", T.StringType()),
])

# crossref_raw_data: bibliographic record nested under raw_data.
CROSSREF_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType(), False),
    T.StructField("publishedAt", T.StructType([
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
    ])),
    T.StructField("raw_data", T.StructType([
        T.StructField("title", T.ArrayType(T.StringType())),
        T.StructField("abstract", T.StringType()),
        T.StructField("container-title", T.ArrayType(T.StringType())),
        T.StructField("publisher", T.StringType()),
        T.StructField("author", T.ArrayType(AUTHOR_RAW)),
        T.StructField("DOI", T.StringType()),
        T.StructField("is-referenced-by-count", T.IntegerType()),
    ])),
])

AUTHOR = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ORCID", T.StringType()),
    T.StructField("sequence", T.StringType()),
])

TOPIC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("relevanceScore", T.DoubleType()),
    T.StructField("topScore", T.DoubleType()),
    T.StructField("hotScore", T.DoubleType()),
    T.StructField("hotScore6m", T.DoubleType()),
])


def papers_schema(dim: int = DEFAULT_DIM) -> T.StructType:
    """Target table. ``dim`` is carried as column metadata and checked on write."""
    return T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("oipubId", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("openSummary", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("authors", T.ArrayType(AUTHOR)),
        T.StructField("publicationDateParts", T.ArrayType(T.IntegerType())),
        T.StructField("publicationHotScore", T.DoubleType()),
        T.StructField("publicationHotScore6m", T.DoubleType()),
        T.StructField("pageRank", T.DoubleType()),
        T.StructField("citationsCount", T.IntegerType()),
        T.StructField("voteScore", T.IntegerType()),
        T.StructField("topics", T.ArrayType(TOPIC)),
        T.StructField("hasAbstract", T.BooleanType()),
        T.StructField("hasOpenSummary", T.BooleanType()),
        T.StructField("publishedAt", T.DateType()),
        T.StructField("embeddingVector", T.ArrayType(T.FloatType()), True,
                      metadata={"dim": dim}),
        T.StructField("contextualContent", T.StringType()),
    ])


PAPER_COLUMNS = [f.name for f in papers_schema().fields]

# Heavy columns never returned by search/list (F1).
EXCLUDED_FROM_RESULTS = ("embeddingVector", "contextualContent")
