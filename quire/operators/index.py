"""Inverted index tables derived from ``papers``.

``postings(field, term, doc, id, tf, dl)``  one row per (field, term, document);
                                      ``dl`` rides along so scoring needs no
                                      join back to per-document statistics
``docs(doc, id, ...)``                what filters and sorts read of a document
``term_stats(field, term, df)``       document frequency per term
``field_stats(field, n_docs, avgdl)`` corpus statistics per field

Statistics are global per field, so scores do not depend on partitioning.

A stored index numbers its documents densely (``doc``) and keeps postings and
docs in buckets by that number, sorted by (field, term) inside: everything
that a document contributes to a request lies in one bucket, so matches are
joined, scored, filtered and counted where they are read and only what a page
or a total needs is shuffled. A request with few terms reads only the row
groups that may hold them (Parquet statistics of the sorted buckets).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.postings import counted_terms
from quire.functions.text import tokens
from quire.operators.mapping import CONTENT_COLUMNS, contextual_content
from quire.session import cut_lineage, dropping_shuffles

# Analysed fields of the papers table.
TEXT_FIELDS = ("title", "abstract", "openSummary", "contextualContent", "journal")


@dataclass
class TextIndex:
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    docs: DataFrame | None = None        # (doc, id, columns for filters and sorts)
    stored: bool = False                 # tables live in the shared folder
    variants: DataFrame | None = None    # fuzzy index: deletion variants of the vocabulary
    english: DataFrame | None = None     # (term, eterm) of the field with an English form
    buckets: int | None = None           # partitions by doc that the postings are computed or stored in
    path: str | None = None              # where the tables lie, if stored
    seed: int | None = None              # of the hash that tells (field, term) apart


def fuzzy_variants(index: TextIndex) -> DataFrame:
    """Deletion variants of the whole vocabulary. For a stored index they are
    written once next to it. Registered searches don't: these rows are many
    times the vocabulary, so a search makes those of the lengths it needs
    where they meet its query terms (``fuzzy_candidates``)."""
    if index.variants is None:
        from quire.functions.fuzzy import vocabulary_variants
        v = vocabulary_variants(index.term_stats.select("term"))
        if index.stored:
            v = cut_lineage(v, "fuzzy_variants")
        index.variants = v
    return index.variants


#: What filters and sorts of a request read of a document, where papers have it.
DOC_COLUMNS = ("publicationHotScore", "pageRank", "publishedAt", "citationsCount", "voteScore", "journal", "topics", "authors", "hasAbstract")


def number_documents(papers: DataFrame) -> DataFrame:
    """``papers`` (read from Parquet files) with dense numbers from 0 in
    ``doc``: the row's place in its file after all rows of the files before.
    Nothing is shuffled but one row per file."""
    rows = papers.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
    files = files.select("__file", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    files = cut_lineage(files, "file_offsets")
    return rows.join(F.broadcast(files), "__file").withColumn("doc", F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def by_document(numbered: DataFrame, fields=TEXT_FIELDS, derived: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """Numbered papers dealt by ``doc`` into as many partitions as their texts
    call for, and that number. The texts are shuffled once, before they become
    postings: these are counted, sorted and stored where their document is.
    ``derived``: columns made of others, which are computed where rows arrive."""
    whole = numbered.withColumns(derived or {})
    chars = whole.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0)).cast("long"))).first()[0] or 0
    buckets = max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    return numbered.drop(*(derived or {})).repartition(buckets, "doc").withColumns(derived or {}), buckets


def field_tokens(papers: DataFrame, fields=TEXT_FIELDS, extra: dict[str, Column] | None = None) -> DataFrame:
    """Long form (field, doc, id, tokens) — one row per document and field.

    ``extra`` maps a field name to a token-array expression (e.g. the
    English-analysed sub-field). Papers without ``doc`` go by their id.
    """
    entries = [F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields]
    for name, expr in (extra or {}).items():
        entries.append(F.struct(F.lit(name).alias("field"), expr.alias("tokens")))
    doc = F.col("doc" if "doc" in papers.columns else "id").alias("doc")
    long = papers.select(doc, "id", F.explode(F.array(*entries)).alias("e"))
    return long.select(F.col("e.field").alias("field"), "doc", "id", F.col("e.tokens").alias("tokens")).where(
        F.size("tokens") > 0)


def build_postings(papers: DataFrame, fields=TEXT_FIELDS, extra: dict[str, Column] | None = None) -> DataFrame:
    """(field, term, doc, id, tf, dl), counted where the document is.

    A contextualContent that is its parts joined by spaces has the tokens of
    the parts (a token holds no space): those count for it too, and only one
    that says something else is analysed itself.
    """
    found = {**{f: tokens(F.col(f)) for f in fields}, **(extra or {})}
    whole, parts = "contextualContent", [f for f in CONTENT_COLUMNS if f in found]
    joined = F.lit(False)
    if whole in fields and len(parts) == len(CONTENT_COLUMNS):
        joined = F.coalesce(F.col(whole) == contextual_content(*map(F.col, CONTENT_COLUMNS)), F.lit(False))
        found[whole] = F.when(joined, F.array().cast("array<string>")).otherwise(found[whole])
    doc = F.col("doc" if "doc" in papers.columns else "id").alias("doc")
    rows = papers.select(doc, "id", joined.alias("joined"), *[t.alias(f"t{i}") for i, t in enumerate(found.values())])
    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), rows.schema["doc"], rows.schema["id"],
                           T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])
    names = list(found)
    both = whole in found and len(parts) == len(CONTENT_COLUMNS)
    return rows.mapInArrow(counted_terms(names, names.index(whole) if both else None, [names.index(f) for f in parts], to_arrow_schema(schema)), schema)


def build_term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def build_field_stats(long_tokens: DataFrame) -> DataFrame:
    return long_tokens.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"),
                                            F.avg(F.size("tokens")).alias("avgdl"))


def build_index(papers: DataFrame, fields=TEXT_FIELDS, extra: dict[str, Column] | None = None, buckets: int | None = None) -> TextIndex:
    """``buckets``: that many partitions by ``doc`` hold the papers already."""
    long = field_tokens(papers, fields, extra)
    postings = build_postings(papers, fields, extra)
    doc = F.col("doc" if "doc" in papers.columns else "id").alias("doc")
    docs = papers.select(doc, "id", *[c for c in DOC_COLUMNS if c in papers.columns])
    return TextIndex(postings, build_term_stats(postings), build_field_stats(long), docs, buckets=buckets)


#: Postings, and characters of analysed texts, aimed at per bucket of a stored index.
BUCKET_POSTINGS = 1_000_000
BUCKET_CHARS = 8_000_000
#: Distinct terms of a batch of requests up to which they are pushed to the scan.
PUSHED_TERMS = 1000


def _bucketed(df: DataFrame, path: str, buckets: int, sort: list[str], dealt: bool = False) -> None:
    """Parquet files of a bucketed table, one a bucket, sorted inside.
    ``dealt``: a bucket's rows are in one partition already."""
    name = f"quire_{uuid.uuid4().hex}"
    df = df if dealt else df.repartition(buckets, "doc")
    df.write.option("path", path).bucketBy(buckets, "doc").sortBy(*sort).format("parquet").mode("overwrite").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: any session names them anew


def _named(spark, path: str, buckets: int, sort: list[str]) -> str:
    name = f"quire_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc) SORTED BY ({', '.join(sort)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def _bucketed_table(spark, path: str, buckets: int, sort: list[str]) -> DataFrame:
    return spark.table(_named(spark, path, buckets, sort))


def _append(df: DataFrame, path: str, buckets: int, sort: list[str]) -> None:
    """More rows for a bucketed table, from partitions by its buckets."""
    name = _named(df.sparkSession, path, buckets, sort)
    df.write.bucketBy(buckets, "doc").sortBy(*sort).format("parquet").mode("append").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def _stored_field_stats(postings: DataFrame) -> DataFrame:
    """Field statistics from postings that lie in buckets by document."""
    docs = postings.groupBy("field", "doc").agg(F.first("dl").alias("dl"))
    return docs.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def write_index(index: TextIndex, path: str, buckets: int | None = None) -> None:
    """Postings and docs in as many buckets as postings call for, or ``buckets``.
    Statistics are taken from what was written, so texts are analysed once."""
    spark = index.postings.sparkSession
    postings, dealt = index.postings, index.buckets is not None and buckets in (None, index.buckets)
    if dealt:
        buckets = index.buckets
    elif buckets is None:
        postings = cut_lineage(postings, "postings")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings.count() // BUCKET_POSTINGS))
    _bucketed(postings, f"{path}/postings", buckets, ["field", "term"], dealt)
    _bucketed(index.docs, f"{path}/docs", buckets, ["doc"])
    spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")
    build_term_stats(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/term_stats")
    if dealt:
        stats = _stored_field_stats(_bucketed_table(spark, f"{path}/postings", buckets, ["field", "term"]))
    else:
        stats = index.field_stats
    stats.write.mode("overwrite").parquet(f"{path}/field_stats")
    if index.english is not None:
        index.english.write.mode("overwrite").parquet(f"{path}/english")


def append_field(index: TextIndex, field: str, postings: DataFrame, english: DataFrame) -> TextIndex:
    """The stored index with the postings of one more field, derived from its
    own where these lie, and the (term, eterm) that they came by."""
    spark, path, sort = index.postings.sparkSession, index.path, ["field", "term"]
    with dropping_shuffles(spark):
        _append(postings, f"{path}/postings", index.buckets, sort)
    added = _bucketed_table(spark, f"{path}/postings", index.buckets, sort).where(F.col("field") == field)
    build_term_stats(added).write.mode("append").parquet(f"{path}/term_stats")
    _stored_field_stats(added).write.mode("append").parquet(f"{path}/field_stats")
    english.write.mode("overwrite").parquet(f"{path}/english")
    return read_index(spark, path, english=True)


def read_index(spark, path: str, english: bool = False) -> TextIndex:
    buckets = spark.read.parquet(f"{path}/layout").first()[0]
    return TextIndex(_bucketed_table(spark, f"{path}/postings", buckets, ["field", "term"]), spark.read.parquet(f"{path}/term_stats"),
                     spark.read.parquet(f"{path}/field_stats"), _bucketed_table(spark, f"{path}/docs", buckets, ["doc"]), stored=True,
                     english=spark.read.parquet(f"{path}/english") if english else None, buckets=buckets, path=path)


def materialize_index(index: TextIndex, name: str = "index") -> TextIndex:
    """The index, stored below the shared checkpoint folder."""
    from quire.session import shared_path
    spark = index.postings.sparkSession
    path = shared_path(spark, "stages", name)
    with dropping_shuffles(spark):
        write_index(index, path)
    return read_index(spark, path, index.english is not None)


def postings_of(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Postings that may hold the (field, term) rows: up to PUSHED_TERMS
    distinct terms are a filter of the scan, which skips row groups by them."""
    if not index.stored:
        return index.postings
    asked = [r[0] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    return index.postings.where(F.col("term").isin(asked)) if len(asked) <= PUSHED_TERMS else index.postings


def hash_seed(index: TextIndex) -> int:
    """A seed under which no two (field, term) of the vocabulary have one hash;
    looked up once for an index."""
    seed = 0
    while index.seed is None:
        hashes = index.term_stats.select(F.xxhash64(F.lit(seed), "field", "term").alias("h"))
        if hashes.groupBy("h").count().where("count > 1").isEmpty():
            index.seed = seed
        seed += 1
    return index.seed


def term_hash(index: TextIndex) -> Column:
    """The hash of a row's field and term."""
    return F.xxhash64(F.lit(hash_seed(index)), "field", "term")
