"""Registered sync, upsert and streaming plans.

Each plan writes its table under a fresh folder of the shared checkpoint
directory, so runs never see each other's state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.embed import EmbeddingStore, HashingEmbedder, PiecewiseEmbedder
from quire.operators import quality
from quire.operators.table import PapersTable, drop_table
from quire.plans.catalog import query
from quire.plans.common import TEST_DIM, flat_paper, papers
from quire.session import cut_lineage, shared_path
from quire.sources.fixtures import crossref_source, flat_sources, read_table, sources, stats_source, vectors_source
from quire.streaming import sync as SY


def _flat(spark, sf) -> DataFrame:
    return flat_sources(spark, read_table(spark, sf, "documents"))


def batch_a(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("doc_id") % 4 < 3)


def batch_b(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("doc_id") % 4 >= 2).withColumn("citations_raw", F.col("citations_raw") + 1)


def arrival(flat: DataFrame, k: int) -> DataFrame:
    """Arrivals 0-3: the source rows split by doc_id % 4; arrival 4: batch B."""
    return batch_b(flat) if k == 4 else flat.where(F.col("doc_id") % 4 == k)


def sync_flat(spark, flat: DataFrame, table: PapersTable, batch_id: int | None, dim: int = TEST_DIM, **options) -> dict:
    return SY.sync(spark, stats_source(flat), crossref_source(flat), table, batch_id, dim, **options)


def _content(t: PapersTable) -> DataFrame:
    """Whole documents, texts by their digest."""
    return flat_paper(t.read(), F.sha2("contextualContent", 256).alias("content"))


def _table(spark, name: str) -> PapersTable:
    return PapersTable(spark, shared_path(spark, "tables", name))


@query
def upsert_apply(spark, sf):
    flat = _flat(spark, sf)
    t = _table(spark, "upsert_apply")
    sync_flat(spark, batch_a(flat), t, 1)
    sync_flat(spark, batch_b(flat), t, 2)
    return _content(t)


@query
def upsert_accounting(spark, sf):
    flat = _flat(spark, sf)
    t = _table(spark, "upsert_accounting")
    a = sync_flat(spark, batch_a(flat), t, 1)
    b = sync_flat(spark, batch_b(flat), t, 2)
    rows = [(name, res, m[res]) for name, m in (("A", a), ("B", b)) for res in ("created", "updated", "rejected")]
    return spark.createDataFrame(rows, "batch string, result string, n long")


@query
def upsert_idempotent(spark, sf):
    flat = _flat(spark, sf)
    t = _table(spark, "upsert_idempotent")
    sync_flat(spark, batch_a(flat), t, 1)
    sync_flat(spark, batch_b(flat), t, 2)
    sync_flat(spark, batch_b(flat), t, None)                  # no batch id: all updates, same content
    assert not sync_flat(spark, batch_a(flat), t, 1)["applied"]  # replays, late and in any order: no-ops
    assert not sync_flat(spark, batch_b(flat), t, 2)["applied"]
    t.compact()
    return _content(t)


def _synced(t: PapersTable) -> DataFrame:
    return t.read().select("id", "title", "journal", F.col("publishedAt").cast("string").alias("published_at"),
                           F.col("citationsCount").cast("long").alias("citationsCount"), "hasAbstract",
                           F.col("embeddingVector").isNotNull().alias("has_vector"))


@query
def sync_full(spark, sf):
    stats, cr = sources(spark, sf)
    t = _table(spark, "sync_full")
    SY.sync(spark, stats, cr, t, batch_id=1, dim=TEST_DIM, vectors=vectors_source(spark, sf))
    return _synced(t)


@query
def sync_embedded(spark, sf):
    """The sync with its embedding step: every accepted document gets a vector."""
    stats, cr = sources(spark, sf)
    t = _table(spark, "sync_embedded")
    SY.sync(spark, stats, cr, t, batch_id=1, dim=TEST_DIM, embedder=HashingEmbedder(TEST_DIM))
    return _synced(t)


def _arrive(spark, sf, base: str, k: int) -> None:
    flat = arrival(_flat(spark, sf), k)
    crossref_source(flat).withColumn("arrived", F.lit(k)).write.mode("append").parquet(f"{base}/crossref")
    stats_source(flat).write.mode("append").parquet(f"{base}/stats")


def _run_stream(spark, base: str, t: PapersTable, stream: str = "default", checkpoint: str = "checkpoint") -> None:
    SY.start_stream_sync(spark, f"{base}/stats", f"{base}/crossref", t, f"{base}/{checkpoint}", TEST_DIM, stream=stream,
                         arrival="arrived").awaitTermination()


def _streamed(spark, sf, name: str) -> PapersTable:
    """Five arrivals, each taken up by a run of the stream."""
    base = shared_path(spark, "streams", name)
    t = PapersTable(spark, f"{base}/table")
    for k in range(5):
        _arrive(spark, sf, base, k)
        _run_stream(spark, base, t)
    return t


@query
def stream_sync(spark, sf):
    return _content(_streamed(spark, sf, "stream_sync"))


@query
def stream_resume(spark, sf):
    base = shared_path(spark, "streams", "stream_resume")
    t = PapersTable(spark, f"{base}/table")
    for k in (0, 1):
        _arrive(spark, sf, base, k)
    _run_stream(spark, base, t)             # first run: two arrivals
    for k in (2, 3):
        _arrive(spark, sf, base, k)
    _run_stream(spark, base, t)             # restart: only the new files
    _arrive(spark, sf, base, 4)
    _run_stream(spark, base, t)
    _run_stream(spark, base, t)             # nothing new: no batch
    return _content(t)


@query
def stream_corrections(spark, sf):
    """Corrections come on the bibliographic side alone: no score row again."""
    base = shared_path(spark, "streams", "stream_corrections")
    t = PapersTable(spark, f"{base}/table")
    flat = _flat(spark, sf)
    stats_source(flat).write.parquet(f"{base}/stats")
    crossref_source(flat).withColumn("arrived", F.lit(0)).write.parquet(f"{base}/crossref")
    _run_stream(spark, base, t)
    crossref_source(batch_b(flat)).withColumn("arrived", F.lit(1)).write.mode("append").parquet(f"{base}/crossref")
    _run_stream(spark, base, t)
    return _content(t)


@query
def sync_status(spark, sf):
    """Totals of all batches; the stages' seconds differ between runs, so what
    is compared is that both were measured."""
    return SY.sync_status(_streamed(spark, sf, "sync_status")).withColumn("map_s", F.col("map_s") > 0).withColumn("write_s", F.col("write_s") > 0)


@query
def published_state(spark, sf):
    """A reader of a published name keeps its state while batches go on; the
    one that is published after the second batch has both."""
    flat = _flat(spark, sf)
    t = _table(spark, "published_state")
    sync_flat(spark, batch_a(flat), t, 1)
    t.publish("stable")
    sync_flat(spark, batch_b(flat), t, 2)
    t.compact()
    t.publish("newest")
    cols = [F.col("id"), F.col("citationsCount").cast("long").alias("citationsCount")]
    return t.read("stable").select(F.lit("stable").alias("name"), *cols).unionByName(t.read("newest").select(F.lit("newest").alias("name"), *cols))


@query
def drop_target(spark, sf):
    """Tables named after each language of the documents, one of a protected
    name and one that is none: rows before, what a drop by name does, rows after."""
    docs = read_table(spark, sf, "documents").where(F.col("lang").isNotNull())
    base = shared_path(spark, "tables", "drop_target")
    folder = F.explode(F.array(F.concat(F.lit("papers_"), F.col("lang")), F.concat(F.lit(".Kibana_"), F.col("lang")))).alias("folder")
    docs.select(folder, "doc_id", F.col("folder").alias("name")).write.partitionBy("folder").parquet(f"{base}/all")
    langs = [r[0] for r in docs.select("lang").distinct().limit(100).collect()]
    before = spark.read.parquet(f"{base}/all").groupBy("name").agg(F.count(F.lit(1)).alias("rows_before"))
    before = cut_lineage(before, "drop_before")
    done = []
    for name in [f"{p}{lang}" for lang in langs for p in ("papers_", ".Kibana_", "gone_")]:
        try:
            outcome = "dropped" if drop_table(spark, f"{base}/all/folder={name}", name) else "missing"
        except PermissionError:
            outcome = "refused"
        done.append((name, outcome))
    left = spark.read.parquet(f"{base}/all").groupBy("name").agg(F.count(F.lit(1)).alias("rows_after"))
    out = spark.createDataFrame(done, "name string, outcome string").join(before, "name", "left").join(left, "name", "left")
    return out.fillna(0, ["rows_before", "rows_after"])


@query
def partition_distribution(spark, sf):
    """Files and rows of a stored table by partition, with their skew; the bytes
    differ between writers, so what is compared is that they were measured."""
    path = shared_path(spark, "tables", "by_source")
    read_table(spark, sf, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("part")).repartition("part").write.partitionBy("part").parquet(path)
    found = quality.partition_distribution(spark.read.parquet(path), "part")
    return found.select("partition", "n_files", "n_rows", "skew", (F.col("n_bytes") > 0).alias("measured"))


@query
def profile_merged(spark, sf):
    """The profile of two batches from the sketches stored beside them, vectors
    too: counts are exact, estimated distinct counts within 5 % of the exact ones."""
    p, path = papers(spark, sf), shared_path(spark, "tables", "sketches")
    older = F.pmod(F.xxhash64("id"), F.lit(3)) > 0
    for part in (p.where(older), p.where(~older)):
        quality.profile_sketch(part).write.mode("append").parquet(path)
    merged = quality.profile_of_sketches(spark.read.parquet(path))
    exact = quality.table_profile(p, exact=True).select("column_name", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(2), F.col("exact") * 0.05)
    return merged.join(exact, "column_name").select("column_name", "row_count", "null_count", near.alias("near"))


@query
def embed_incremental(spark, sf):
    """Embeddings by content: how many texts each of three passes has to embed
    (batch A, all documents, all again) and how many rows got a vector."""
    p = papers(spark, sf).select("id", "contextualContent", "citationsCount")
    store = EmbeddingStore(spark, shared_path(spark, "tables", "embeddings"), TEST_DIM, PiecewiseEmbedder(HashingEmbedder(TEST_DIM)))
    number = F.substring("id", 2, 20).cast("long")
    out = None
    for k, rows in enumerate((p.where(number % 4 < 3), p, p)):
        found, embedded = store.embed(rows, "contextualContent")
        one = found.agg(F.lit(k).cast("long").alias("pass"), F.lit(embedded).cast("long").alias("texts_embedded"),
                        F.count_if(F.size("embedding") == TEST_DIM).alias("rows_with_vector"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def recent_errors(spark, sf):
    return SY.recent_errors(_streamed(spark, sf, "recent_errors"))
