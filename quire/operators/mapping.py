"""Join the two source collections and map them into the ``papers`` schema.

One ``select`` of native column expressions (no Python per row). Rows that
cannot be used are not dropped silently: they land in a reject table with a
reason, and the job never fails because of one bad document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import WS_CLASS, clean_text, first_or_empty, is_blank, not_blank, sanitize_double
from quire.operators.table import newest_per_key
from quire.schema import PAPER_COLUMNS, papers_schema

# Reject reasons, in the order they are tested.
NO_CROSSREF = "no_crossref"
INVALID_DATE = "invalid_date"
NO_TITLE_OR_ABSTRACT = "no_title_or_abstract"

UNKNOWN_DATE = "0001-01-01"

# Mapped texts that contextualContent is made of.
CONTENT_COLUMNS = ("title", "abstract", "openSummary")


def utrim(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def map_topics(topics: Column) -> Column:
    """topicRelatedScores -> topics: rename hotScore_6m, defaults, sanitised scores."""
    arr = F.coalesce(topics, F.array().cast("array<struct<name:string,relevanceScore:double,topScore:double,"
                                            "hotScore:double,hotScore_6m:double>>"))
    return F.transform(arr, lambda t: F.struct(
        F.coalesce(t["name"], F.lit("")).alias("name"),
        sanitize_double(t["relevanceScore"]).alias("relevanceScore"),
        sanitize_double(t["topScore"]).alias("topScore"),
        sanitize_double(t["hotScore"]).alias("hotScore"),
        sanitize_double(t["hotScore_6m"]).alias("hotScore6m"),
    ))


def map_authors(authors: Column) -> Column:
    """Drop authors with empty given and family; name = trim(given + ' ' + family)."""
    arr = F.coalesce(authors, F.array().cast("array<struct<given:string,family:string,ORCID:string,sequence:string>>"))
    g = lambda a: F.coalesce(a["given"], F.lit(""))
    f = lambda a: F.coalesce(a["family"], F.lit(""))
    kept = F.filter(arr, lambda a: (g(a) != "") | (f(a) != ""))
    return F.transform(kept, lambda a: F.struct(
        utrim(F.concat(g(a), F.lit(" "), f(a))).alias("name"),
        F.coalesce(a["ORCID"], F.lit("")).alias("ORCID"),
        F.coalesce(a["sequence"], F.lit("")).alias("sequence"),
    ))


def published_at(year: Column, month: Column, day: Column) -> Column:
    """Date from parts; month/day default to 1; null when the parts are invalid."""
    ts = F.try_make_timestamp(year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)),
                              F.lit(0), F.lit(0), F.lit(0))
    return F.when(year.isNull(), F.lit(UNKNOWN_DATE).cast("date")).otherwise(ts.cast("date"))


def date_parts(year: Column, month: Column, day: Column) -> Column:
    """[year] + month if present + day if present; empty without a year."""
    return F.when(year.isNull(), F.array().cast("array<int>")).otherwise(
        F.filter(F.array(year, month, day), lambda x: x.isNotNull()))


def contextual_content(*texts: Column) -> Column:
    return F.concat_ws(" ", F.filter(F.array(*texts), lambda x: not_blank(x)))


def join_sources(stats: DataFrame, crossref: DataFrame) -> DataFrame:
    """stats LEFT JOIN crossref on _id. Unmatched rows are kept for the reject table.

    Sort-merge at scale (both sides keyed by _id); AQE may switch to a
    broadcast at run time when one side turns out small. Repeated crossref
    ids multiply no rows: of several the last by hash counts, or the caller
    picks by a column of its own with ``newest_per_key`` before.
    """
    crossref = newest_per_key(crossref, ["_id"])
    cr = crossref.select(F.col("_id"), F.col("publishedAt").alias("_pub"), F.col("raw_data").alias("_raw"),
                         F.lit(True).alias("_has_crossref"))
    return stats.join(cr, "_id", "left")


def map_joined(joined: DataFrame) -> DataFrame:
    """Mapped rows of the join plus a ``_reason`` column (null = accepted)."""
    raw = F.col("_raw")
    year, month, day = F.col("_pub.year"), F.col("_pub.month"), F.col("_pub.day")
    title = clean_text(first_or_empty(raw["title"]))
    abstract = clean_text(raw["abstract"])
    open_summary = clean_text(F.lit(""))
    pub = published_at(year, month, day)

    step1 = joined.select(
        F.col("_id").alias("id"),
        F.lit("0").alias("oipubId"),
        F.coalesce(raw["DOI"], F.col("_id")).alias("doi"),
        title.alias("title"),
        abstract.alias("abstract"),
        open_summary.alias("openSummary"),
        first_or_empty(raw["container-title"]).alias("journal"),
        F.coalesce(raw["publisher"], F.lit("")).alias("publisher"),
        map_authors(raw["author"]).alias("authors"),
        date_parts(year, month, day).alias("publicationDateParts"),
        sanitize_double("publicationHotScore").alias("publicationHotScore"),
        sanitize_double("publicationHotScore_6m").alias("publicationHotScore6m"),
        sanitize_double("pageRank").alias("pageRank"),
        F.coalesce(raw["is-referenced-by-count"], F.lit(0)).cast("int").alias("citationsCount"),
        F.lit(0).alias("voteScore"),
        map_topics(F.col("topicRelatedScores")).alias("topics"),
        pub.alias("publishedAt"),
        F.col("_has_crossref"),
    )
    return step1.select(
        *[c for c in step1.columns if c != "_has_crossref"],
        not_blank(F.col("abstract")).alias("hasAbstract"),
        not_blank(F.col("openSummary")).alias("hasOpenSummary"),
        contextual_content(*map(F.col, CONTENT_COLUMNS)).alias("contextualContent"),
        F.when(F.col("_has_crossref").isNull(), F.lit(NO_CROSSREF))
         .when(F.col("publishedAt").isNull(), F.lit(INVALID_DATE))
         .when(is_blank(F.col("title")) & is_blank(F.col("abstract")), F.lit(NO_TITLE_OR_ABSTRACT))
         .alias("_reason"),
    )


def attach_vectors(mapped: DataFrame, vectors: DataFrame | None, dim: int | None = None) -> DataFrame:
    """Left join of embeddings keyed by id (no positional alignment).

    Vectors of the wrong dimension are stored as null, never as a bad row.
    """
    if vectors is None:
        return mapped.withColumn("embeddingVector", F.lit(None).cast("array<float>"))
    v = vectors.select("id", F.col("embeddingVector").cast("array<float>").alias("embeddingVector"))
    if dim is not None:
        v = v.where(F.size("embeddingVector") == dim)
    return mapped.join(v, "id", "left")


def to_papers(mapped: DataFrame, dim: int | None = None) -> DataFrame:
    schema = papers_schema(dim or 768)
    return mapped.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def map_papers(stats: DataFrame, crossref: DataFrame, vectors: DataFrame | None = None,
               dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (papers, rejects). ``rejects`` has (id, reason)."""
    mapped = map_joined(join_sources(stats, crossref))
    accepted = mapped.where(F.col("_reason").isNull()).drop("_reason")
    papers = to_papers(attach_vectors(accepted, vectors, dim), dim)
    rejects = mapped.where(F.col("_reason").isNotNull()).select("id", F.col("_reason").alias("reason"))
    return papers, rejects


__all__ = ["map_papers", "map_joined", "join_sources", "map_topics", "map_authors", "published_at", "date_parts",
           "contextual_content", "attach_vectors", "to_papers", "PAPER_COLUMNS", "NO_CROSSREF", "INVALID_DATE",
           "NO_TITLE_OR_ABSTRACT"]
