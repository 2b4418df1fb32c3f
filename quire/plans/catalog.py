"""Registered query plans: each takes (spark, sf_dir) and returns a DataFrame.

Every plan reads the driver tables (or what Spark derives from them) in
full; request parameters are plain values, the data is never subset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import clean_text, decode_entities, sanitize_double
from quire.operators import filters as flt
from quire.operators import listing, quality
from quire.operators.mapping import NO_TITLE_OR_ABSTRACT
from quire.operators.requests import norm_sync_size, normalize_requests, split_topics
from quire.operators.vector import valid_vector
from quire.plans.common import AS_OF, TEST_DIM, flat_paper, mapped_all, names_of, papers, papers_and_rejects, text_queries
from quire.schema import CROSSREF_SCHEMA
from quire.session import shared_path
from quire.sources.fixtures import crossref_source, flat_sources, read_table, sources
from quire.sources.scan import keyset_page, point_lookup, read_json_payload, read_source_files, sample_n

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _num_key(c: str = "_id"):
    return F.substring(F.col(c), 2, 64).cast("long")


# ---------------------------------------------------------------- sources
@query
def keyset_page_q(spark, sf):
    stats, _ = sources(spark, sf)
    page = keyset_page(stats, 200, "p00000100")
    return page.select(F.col("_id").alias("id"), F.col("pageRank"),
                       F.size("topicRelatedScores").cast("long").alias("n_topics"))


@query
def sample_n_q(spark, sf):
    stats, _ = sources(spark, sf)
    return sample_n(stats, 100, seed=7, key=_num_key(), tie="_id").select(F.col("_id").alias("id"), "pageRank")


@query
def point_lookup_q(spark, sf):
    stats, cr = sources(spark, sf)
    out = point_lookup(cr, stats.select("_id"))
    return out.select(F.col("_id").alias("id"), F.col("raw_data").isNotNull().alias("found"),
                      F.col("raw_data.DOI").alias("doi"))


@query
def read_sources_q(spark, sf):
    """Crossref records exported as files of JSON lines, a few of them cut
    short on the way, read with the declared schema."""
    flat = flat_sources(spark, read_table(spark, sf, "documents"))
    cr = crossref_source(flat)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cr.columns]))
    cut = F.substring("_id", 2, 8).cast("int") % 59 == 11
    path = shared_path(spark, "stages", "export")
    cr.select(F.when(cut, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value")).write.text(path)
    lines = read_source_files(spark, path, T.StructType([T.StructField("value", T.StringType())]), "text")
    parsed = read_json_payload(lines, "value", CROSSREF_SCHEMA)
    raw, pub = F.col("_parsed.raw_data"), F.col("_parsed.publishedAt")
    return parsed.select(
        F.regexp_extract("value", '"_id":"([^"]*)"', 1).alias("id"),
        pub["year"].cast("long").alias("year"), pub["month"].cast("long").alias("month"), pub["day"].cast("long").alias("day"),
        F.get(raw["title"], 0).alias("title_raw"), raw["DOI"].alias("doi"), F.size(raw["author"]).cast("long").alias("n_authors"),
        raw["is-referenced-by-count"].cast("long").alias("citations"), "parse_error")


@query
def join_sources_q(spark, sf):
    m = mapped_all(spark, sf)
    return m.select("id", (F.col("_reason").isNull() | (F.col("_reason") != "no_crossref")).alias("matched"))


@query
def rejects_by_reason(spark, sf):
    _, rejects = papers_and_rejects(spark, sf, with_vectors=False)
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- mapping
@query
def clean_text_q(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", clean_text("html").alias("text"))


@query
def decode_entities_q(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", decode_entities("html").alias("decoded"))


@query
def sanitize_scores(spark, sf):
    stats, _ = sources(spark, sf)
    return stats.select(F.col("_id").alias("id"), sanitize_double("publicationHotScore").alias("publicationHotScore"),
                        sanitize_double("publicationHotScore_6m").alias("publicationHotScore6m"),
                        sanitize_double("pageRank").alias("pageRank"))


@query
def map_topics_q(spark, sf):
    m = mapped_all(spark, sf)
    agg = lambda f: F.round(F.aggregate(F.col("topics"), F.lit(0.0), lambda acc, t: acc + t[f]), 6)
    return m.select("id", F.size("topics").cast("long").alias("n_topics"),
                    names_of("topics", "name", ", ").alias("topic_names"),
                    agg("relevanceScore").alias("relevance_sum"), agg("topScore").alias("top_sum"),
                    agg("hotScore").alias("hot_sum"), agg("hotScore6m").alias("hot6m_sum"))


@query
def published_at_q(spark, sf):
    m = mapped_all(spark, sf).where(F.col("_reason").isNull() | (F.col("_reason") != "no_crossref"))
    return m.select("id", F.col("publishedAt").cast("string").alias("published_at"),
                    F.array_join(F.col("publicationDateParts"), "-").alias("date_parts"))


@query
def map_authors_q(spark, sf):
    m = mapped_all(spark, sf).where(F.col("_reason").isNull() | (F.col("_reason") != "no_crossref"))
    return m.select("id", names_of("authors", "name", "; ").alias("author_names"),
                    names_of("authors", "sequence", ",").alias("sequences"),
                    F.size("authors").cast("long").alias("n_authors"))


@query
def contextual_content_q(spark, sf):
    return papers(spark, sf).select("id", "contextualContent")


@query
def drop_unusable(spark, sf):
    _, rejects = papers_and_rejects(spark, sf, with_vectors=False)
    return rejects.where(F.col("reason") == NO_TITLE_OR_ABSTRACT).select("id")


@query
def map_paper(spark, sf):
    p = papers(spark, sf)
    return p.select(
        "id", "oipubId", "doi", "title", "abstract", "openSummary", "journal", "publisher",
        names_of("authors", "name", "; ").alias("author_names"),
        F.array_join("publicationDateParts", "-").alias("date_parts"),
        F.col("publishedAt").cast("string").alias("published_at"),
        "publicationHotScore", "publicationHotScore6m", "pageRank",
        F.col("citationsCount").cast("long").alias("citationsCount"), F.col("voteScore").cast("long").alias("voteScore"),
        names_of("topics", "name", ", ").alias("topic_names"), "hasAbstract", "hasOpenSummary")


@query
def sync_summary(spark, sf):
    m = mapped_all(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("retrieved"),
                 F.sum(F.when(F.col("_reason").isNull(), 1).otherwise(0)).cast("long").alias("processed"),
                 F.sum(F.when(F.col("_reason").isNotNull(), 1).otherwise(0)).cast("long").alias("skipped"),
                 F.max("id").alias("last_id"))


# ---------------------------------------------------------------- requests
def request_table(spark, sf):
    """Semantic-search style requests, parameters derived from the benchmark ids."""
    q = text_queries(spark, sf)
    sorts = F.array(*[F.lit(s) for s in ("HOT", "top", "zzz", "latest", "Date")])
    return q.select(
        "query_id",
        F.when(F.col("query_id") % 10 == 3, F.lit("   ")).otherwise(F.col("query")).alias("query"),
        ((F.col("query_id") % 7) - 1).cast("int").alias("page"),
        (((F.col("query_id") * 13) % 130) - 10).cast("int").alias("per_page"),
        F.get(sorts, (F.col("query_id") % 5).cast("int")).alias("sort"))


@query
def normalize_requests_q(spark, sf):
    out = normalize_requests(request_table(spark, sf), "semantic")
    return out.select("query_id", F.col("page").cast("long"), F.col("per_page").cast("long"), "sort",
                      F.col("from").cast("long"), F.col("size").cast("long"), "rejected_reason",
                      norm_sync_size(F.col("query_id") * 331 - 20).cast("long").alias("sync_size"))


# ---------------------------------------------------------------- listings
def _listing(df):
    return flat_paper(df, F.col("rank").cast("long").alias("rank"))


@query
def list_latest(spark, sf):
    return _listing(listing.list_papers(papers(spark, sf), 1, 10, "latest", None, AS_OF))


@query
def list_hot(spark, sf):
    return _listing(listing.list_papers(papers(spark, sf), 1, 10, "HOT", None, AS_OF))


@query
def list_top(spark, sf):
    return _listing(listing.list_papers(papers(spark, sf), 1, 10, "top", None, AS_OF))


@query
def list_page2(spark, sf):
    return _listing(listing.list_papers(papers(spark, sf), 2, 25, "latest", True, AS_OF))


def _topic(spark, sf, topic, sort, page=1, per_page=20):
    df = listing.list_by_topic(papers(spark, sf), topic, page, per_page, sort, AS_OF)
    return df


@query
def topic_hot(spark, sf):
    return _listing(_topic(spark, sf, "machine learning", "hot"))


@query
def topic_top(spark, sf):
    return _listing(_topic(spark, sf, "ensemble", "top"))


@query
def topic_relevance(spark, sf):
    return _listing(_topic(spark, sf, "data mining", "relevance", page=2, per_page=15))


@query
def topic_latest(spark, sf):
    return _listing(_topic(spark, sf, "microfinance", "latest"))


@query
def topic_inner_hits(spark, sf):
    df = _topic(spark, sf, "neural networks", "hot", per_page=30)
    return df.select("id", F.col("rank").cast("long").alias("rank"), F.col("inner_hit.relevanceScore").alias("relevanceScore"),
                     F.col("inner_hit.topScore").alias("topScore"), F.col("inner_hit.hotScore").alias("hotScore"))


# ---------------------------------------------------------------- filters
@query
def filter_journal(spark, sf):
    return flat_paper(papers(spark, sf).where(flt.journal_is("Journal of src3")))


@query
def filter_journal_term(spark, sf):
    """Compatibility mode: the value must equal one analysed token of the journal."""
    return flat_paper(papers(spark, sf).where(flt.journal_is("src3", mode="term")))


@query
def filter_dates(spark, sf):
    return flat_paper(papers(spark, sf).where(flt.date_between("2000-01-01", "2010-06-30")))


@query
def filter_topics(spark, sf):
    wanted = split_topics(F.lit("ensemble,data mining,,"))
    return flat_paper(papers(spark, sf).where(flt.topics_any(wanted)))


@query
def filter_author(spark, sf):
    return flat_paper(papers(spark, sf).where(flt.author_is("Co Author3")))


@query
def filter_has_abstract(spark, sf):
    return flat_paper(papers(spark, sf).where(flt.has_abstract_is(False)))


@query
def select_fields(spark, sf):
    p = papers(spark, sf).select("id", "title", F.struct(
        F.col("publicationHotScore").alias("hotScore"), "pageRank", "citationsCount").alias("scores"))
    return p.select("id", "title", F.col("scores.hotScore").alias("hotScore"), F.col("scores.pageRank").alias("pageRank"),
                    F.col("scores.citationsCount").cast("long").alias("citationsCount"))


@query
def page_metadata(spark, sf):
    p = papers(spark, sf)
    matched = listing.result_columns(p).where(flt.not_in_future(AS_OF))
    page = listing.list_papers(p, 3, 10, "latest", None, AS_OF)
    withtot = listing.with_total_hits(page, matched)
    return withtot.select(F.col("rank").cast("long").alias("rank"), "id",
                          *listing.page_metadata(F.col("total_hits").cast("long"), F.lit(3), F.lit(10)))


# ---------------------------------------------------------------- reports
@query
def total_count(spark, sf):
    return quality.total_count(papers(spark, sf)).select(F.col("total").cast("long"))


def _batches(spark, sf):
    flat = flat_sources(spark, read_table(spark, sf, "documents"))
    a = flat.where(F.col("doc_id") % 4 < 3).select("id", "citations_raw")
    b = flat.where(F.col("doc_id") % 4 >= 2).select("id", (F.col("citations_raw") + 1).alias("citations_raw"))
    return a, b


@query
def duplicate_ids(spark, sf):
    a, b = _batches(spark, sf)
    d = quality.duplicate_ids(a.unionByName(b), "id")
    return d.select("id", F.col("doc_count").cast("long"), F.col("value_count").cast("long"))


@query
def table_profile(spark, sf):
    return quality.table_profile(papers(spark, sf), exact=True).select("column_name", "row_count", "null_count", "distinct_count")


@query
def data_distribution(spark, sf):
    p = papers(spark, sf)
    return quality.data_distribution(p, 16, key=_num_key("id"), portable_key=True)


@query
def author_profiles(spark, sf):
    return quality.author_profiles(papers(spark, sf)).select(
        "author", "orcid", F.col("n_papers").cast("long"), "citations",
        F.col("first_year").cast("long"), F.col("last_year").cast("long"))


@query
def journal_by_year(spark, sf):
    return quality.journal_by_year(papers(spark, sf)).select(
        "journal", F.col("year").cast("long"), F.col("n_papers").cast("long"), "citations", "avg_hot")


@query
def topic_trends(spark, sf):
    return quality.topic_trends(papers(spark, sf)).withColumn("n_papers", F.col("n_papers").cast("long"))


@query
def parse_payload(spark, sf):
    """Event payloads; those of some events arrive without their last brace."""
    props = F.when(F.col("event_id") % 97 == 3, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    ev = read_table(spark, sf, "events").withColumn("props", props)
    out = read_json_payload(ev, "props", T.StructType([T.StructField("k", T.LongType())]))
    return out.select("event_id", F.col("_parsed.k").alias("k"), "parse_error")


@query
def protected_names(spark, sf):
    docs = read_table(spark, sf, "documents").select("source", "lang").distinct()
    names = docs.select(F.explode(F.array(
        F.col("source"), F.concat(F.lit(".Kibana_"), F.col("source")), F.concat(F.lit(".security-"), F.col("lang")),
        F.concat(F.lit("papers_"), F.col("lang")), F.concat(F.lit(".OpenSearch-"), F.col("source")))).alias("name")).distinct()
    return names.select("name", quality.is_protected(F.col("name")).alias("protected"))


@query
def vector_dim_check(spark, sf):
    """Vectors that may be searched; some arrive cut short or all zero."""
    v = (F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, TEST_DIM - 1))
         .when(F.col("vec_id") % 10 == 7, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    emb = read_table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return emb.select("vec_id", F.size("v").cast("long").alias("dim"), valid_vector(F.col("v"), TEST_DIM).alias("valid"))


EXTENSIONS = ("quire.plans.catalog_search", "quire.plans.catalog_vector", "quire.plans.catalog_sync")


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import importlib
    for mod in EXTENSIONS:
        importlib.import_module(mod)
    out = {}
    for name, fn in QUERIES.items():
        out[name[:-2] if name.endswith("_q") else name] = fn
    return out
