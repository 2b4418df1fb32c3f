"""Data-quality and analytics reports over the ``papers`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.scan import arithmetic_hash

# Protected name prefixes (compared case-insensitively).
PROTECTED_PREFIXES = (".opensearch", ".security", ".kibana", ".opendistro")


def duplicate_ids(df: DataFrame, key: str = "id", min_count: int = 2, limit: int | None = None) -> DataFrame:
    """Keys present at least ``min_count`` times; with ``limit`` the most
    frequent ones only (a top-k report).

    Partial aggregation per partition before the shuffle, so a hot key costs
    one row per partition, not one per copy.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("doc_count"), F.count(F.col(key)).alias("value_count"))
    found = counts.where(F.col("doc_count") >= min_count)
    return found if limit is None else found.orderBy(F.col("doc_count").desc(), F.col(key)).limit(limit)


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def table_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values and bytes of its
    values as text. Arrays and structs are profiled through their JSON text.

    Approximate distinct counts (the default) take one pass; exact ones take
    an aggregation per column, each reading its column only, rather than one
    that multiplies every row by the number of columns; long values are told
    apart by their digests, so no text is shuffled.
    """
    def text(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        return F.to_json(f"`{c}`") if kind in ("array", "struct", "map") else F.col(f"`{c}`").cast("string")

    def facts(c: str, distinct: Column) -> Column:
        return F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(f"`{c}`").isNull()).alias("null_count"),
                        distinct.alias("distinct_count"), F.coalesce(F.sum(F.octet_length(text(c))), F.lit(0)).alias("text_bytes"))

    if exact:
        out = None
        for c in df.columns:
            one = df.select(f"`{c}`").agg(facts(c, F.count_distinct(_told_apart(df, c, text(c)))).alias("f")).select("f.*")
            out = one if out is None else out.unionByName(one)
        return out
    return df.agg(F.array(*[facts(c, F.approx_count_distinct(text(c))) for c in df.columns]).alias("fs")).select(F.inline("fs"))


def _told_apart(df: DataFrame, c: str, text: Column) -> Column:
    """A value that is short and equal just where the column's values are."""
    kind = df.schema[c].dataType.typeName()
    return F.unhex(F.md5(text)) if kind in ("string", "binary", "array", "struct", "map") else text


SKETCH_COLUMNS = ("column_name", "data_type", "rows", "nulls", "text_bytes", "sketch")


def profile_sketch(df: DataFrame) -> DataFrame:
    """(column_name, data_type, rows, nulls, text_bytes, sketch), one row per
    column, in one pass: what a profile needs of a batch, a few KB a column,
    to be stored beside the batch and merged with others'."""
    def text(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        return F.to_json(f"`{c}`") if kind in ("array", "struct", "map") else F.col(f"`{c}`").cast("string")

    facts = [F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"), F.count(F.lit(1)).alias("rows"),
                      F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), F.coalesce(F.sum(F.octet_length(text(c))), F.lit(0)).alias("text_bytes"),
                      F.hll_sketch_agg(_told_apart(df, c, text(c)), F.lit(SKETCH_BITS)).alias("sketch")) for c in df.columns]
    return df.agg(F.array(*facts).alias("fs")).select(F.inline("fs"))


#: Registers (log2) of a distinct-count sketch: a standard error of about 0.8 %.
SKETCH_BITS = 14


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """The profile of all batches together from their sketches: columns as in
    ``table_profile``, ``distinct_count`` is an estimate."""
    merged = sketches.groupBy("column_name", "data_type").agg(
        F.sum("rows").alias("row_count"), F.sum("nulls").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"), F.sum("text_bytes").alias("text_bytes"))
    return merged


def _with_mean(counts: DataFrame) -> DataFrame:
    """``counts`` with the mean of its n_rows in ``mean`` (one row, broadcast)."""
    one = F.lit(1).alias("_one")
    mean = counts.agg(F.avg("n_rows").alias("mean")).select("mean", one)
    return counts.select("*", one).join(F.broadcast(mean), "_one").drop("_one")


def file_distribution(stored: DataFrame, partition: str | None = None) -> DataFrame:
    """(file, partition, n_rows, n_bytes, skew) of every file of a table read
    from files; skew is its rows over the mean of all files. ``partition``
    names a partition column to report beside the file."""
    by = [F.col("_metadata.file_path").alias("file"), (F.col(partition).cast("string") if partition else F.lit(None).cast("string")).alias("partition")]
    files = stored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.max("_metadata.file_size").alias("n_bytes"))
    return _with_mean(files).select("file", "partition", "n_rows", "n_bytes", F.round(F.col("n_rows") / F.col("mean"), 6).alias("skew"))


def partition_distribution(stored: DataFrame, partition: str) -> DataFrame:
    """(partition, n_files, n_rows, n_bytes, skew) of every partition folder."""
    parts = file_distribution(stored, partition).groupBy("partition").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    return _with_mean(parts).select("partition", "n_files", "n_rows", "n_bytes", F.round(F.col("n_rows") / F.col("mean"), 6).alias("skew"))


def bucket_of(key: Column, buckets: int, portable_key: bool = False) -> Column:
    if portable_key:
        return F.pmod(arithmetic_hash(key), F.lit(buckets))
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def data_distribution(df: DataFrame, buckets: int = 16, key: Column | None = None, portable_key: bool = False) -> DataFrame:
    """Rows per hash bucket with the skew of the largest bucket (max / mean)."""
    k = key if key is not None else F.col("id")
    per = df.groupBy(bucket_of(k, buckets, portable_key).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
    stats = per.agg(F.max("n_rows").alias("_mx"), F.avg("n_rows").alias("_avg"), F.min("n_rows").alias("_mn"))
    stats = stats.withColumn("_one", F.lit(1))
    return per.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one").select(
        F.col("bucket").cast("long"), F.col("n_rows").cast("long"),
        F.col("_mn").cast("long").alias("min_rows"), F.col("_mx").cast("long").alias("max_rows"),
        F.round(F.col("_mx") / F.col("_avg"), 6).alias("skew"))


def author_profiles(papers: DataFrame) -> DataFrame:
    a = papers.select("id", "citationsCount", "publishedAt", F.explode("authors").alias("a"))
    return a.groupBy(F.col("a.name").alias("author"), F.col("a.ORCID").alias("orcid")).agg(
        F.count(F.lit(1)).alias("n_papers"),
        F.sum("citationsCount").cast("long").alias("citations"),
        F.min(F.year("publishedAt")).alias("first_year"),
        F.max(F.year("publishedAt")).alias("last_year"),
    )


def journal_by_year(papers: DataFrame) -> DataFrame:
    return papers.groupBy("journal", F.year("publishedAt").alias("year")).agg(
        F.count(F.lit(1)).alias("n_papers"),
        F.sum("citationsCount").cast("long").alias("citations"),
        F.round(F.avg("publicationHotScore"), 6).alias("avg_hot"),
    )


def topic_trends(papers: DataFrame) -> DataFrame:
    t = papers.select("id", "citationsCount", "pageRank", F.explode("topics").alias("t"))
    return t.groupBy(F.col("t.name").alias("topic")).agg(
        F.count(F.lit(1)).alias("n_papers"),
        F.round(F.avg("t.hotScore"), 6).alias("avg_topic_hot"),
        F.round(F.avg("t.topScore"), 6).alias("avg_topic_top"),
        F.sum("citationsCount").cast("long").alias("citations"),
        F.round(F.avg("pageRank"), 6).alias("avg_pagerank"),
    )


def is_protected(name: Column) -> Column:
    low = F.lower(name)
    cond = F.lit(False)
    for p in PROTECTED_PREFIXES:
        cond = cond | low.startswith(p)
    return cond


def is_protected_name(name: str) -> bool:
    """``is_protected`` for one name."""
    return name.lower().startswith(PROTECTED_PREFIXES)
