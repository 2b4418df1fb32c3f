"""Sync jobs: sources -> papers table, as one batch job or as a stream.

Batch: the whole source is one distributed job (no cursor loop).
Stream: files of score rows and files of bibliographic rows are one stream of
changes. A streaming aggregation keeps the last row of either kind for every
id in the state store (RocksDB), and hands on the ids that a micro-batch has
changed with both of their rows: the work of a batch follows its changes,
neither source is read again. A corrected title reaches ``papers`` without a
new score row, and a score row that comes before its bibliographic row is a
reject until that comes. Each micro-batch is one keyed upsert under its epoch
id; a replayed epoch changes nothing. Metrics are columns of the table's log,
rejects are written with the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.functions.embed import embed_column
from quire.operators.mapping import CONTENT_COLUMNS, NO_CROSSREF, attach_vectors, contextual_content, join_sources, map_joined, to_papers
from quire.operators.table import PapersTable, now
from quire.schema import CROSSREF_SCHEMA, STATS_SCHEMA, papers_schema
from quire.session import cut_lineage, create_exclusive, delete_path

#: Fixed value: how many errors the report shows by default.
RECENT_ERRORS = 50


def sync(spark: SparkSession, stats: DataFrame, crossref: DataFrame, table: PapersTable, batch_id: int | None = None,
         dim: int = 768, vectors: DataFrame | None = None, embedder: Callable | None = None, stream: str = "default") -> dict:
    """Map, embed and upsert one batch of source rows; returns its metrics."""
    table.create_if_absent(papers_schema(dim))
    if table.applied(stream, batch_id):
        return dict(_NOTHING, batch_id=batch_id)
    return sync_joined(join_sources(stats, crossref), table, batch_id, dim, vectors, embedder, stream)


_NOTHING = {"batch_id": None, "applied": False, "retrieved": 0, "indexed": 0, "created": 0, "updated": 0, "rejected": 0}


def sync_joined(joined: DataFrame, table: PapersTable, batch_id: int | None, dim: int, vectors: DataFrame | None = None,
                embedder: Callable | None = None, stream: str = "default", *, skip_empty: bool = False) -> dict:
    """The same from rows of ``join_sources``. The mapped rows are written once,
    without the content that is put together of their texts."""
    started = now()
    # the counts are taken while the mapped rows are written, not by a pass of their own
    seen = Observation()
    observed = map_joined(joined).drop("contextualContent").observe(
        seen, F.count(F.lit(1)).alias("retrieved"), F.count_if(F.col("_reason").isNull()).alias("indexed"), F.max("id").alias("last_id"))
    mapped = cut_lineage(observed, "sync_mapped")
    counts = seen.get
    if skip_empty and not counts["retrieved"]:
        return dict(_NOTHING, batch_id=batch_id)
    accepted = mapped.where(F.col("_reason").isNull()).drop("_reason")
    accepted = accepted.withColumn("contextualContent", contextual_content(*map(F.col, CONTENT_COLUMNS)))
    if vectors is not None:
        accepted = attach_vectors(accepted, vectors, dim)
    elif embedder is not None:
        accepted = embed_column(accepted, "contextualContent", dim, embedder, column="embeddingVector")
    else:
        accepted = attach_vectors(accepted, None)
    rejects = mapped.where(F.col("_reason").isNotNull()).select("id", F.col("_reason").alias("reason"))
    facts = {"retrieved": counts["retrieved"], "indexed": counts["indexed"], "rejected": counts["retrieved"] - counts["indexed"],
             "last_id": counts["last_id"], "started_at": started, "map_s": (now() - started).total_seconds()}
    res = table.upsert(to_papers(accepted, dim), batch_id, stream=stream, rejects=rejects, facts=facts)
    return {"batch_id": batch_id, "applied": res.applied, "created": res.created, "updated": res.updated, **facts}


def sync_status(table: PapersTable) -> DataFrame:
    """Totals over all applied batches, and the seconds of their stages."""
    m = table.log().where("kind = 'batch'")
    return m.agg(F.count(F.lit(1)).alias("batches"), F.sum("retrieved").alias("total_retrieved"),
                 F.sum("indexed").alias("total_indexed"), F.sum("created").alias("total_created"),
                 F.sum("updated").alias("total_updated"), F.sum("rejected").alias("total_rejected"),
                 F.max("last_id").alias("last_id"), F.sum("map_s").alias("map_s"), F.sum("write_s").alias("write_s"))


def recent_errors(table: PapersTable, n: int = RECENT_ERRORS) -> DataFrame:
    """Newest ``n`` rejects by batch, then message (a top-k report)."""
    batches = table.log().select("batch", "batch_id", "seq")
    message = F.concat(F.lit("rejected "), F.col("id"), F.lit(": "), F.col("reason"))
    e = table.rejects().join(batches, "batch").select("batch_id", "seq", message.alias("message"))
    return e.orderBy(F.col("seq").desc(), "message").limit(n).select("batch_id", "message")


#: A state store that keeps its state on disk, not in the executors' heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_rows(stats: DataFrame, crossref: DataFrame, arrival: str | None = None) -> DataFrame:
    """(_id, stats, crossref): the last row of either kind of every id (null
    where there is none). Of several the one that arrived last: by ``arrival``
    (a column of the bibliographic rows, and of score rows that have it), then
    by the time of its file, then by its hash, the same in every run.

    On streams this is a native streaming aggregation, whose update mode
    yields the ids that a micro-batch has changed.
    """
    def side(df: DataFrame, fields: list[str], name: str) -> DataFrame:
        came = F.col(arrival) if arrival and arrival in df.columns else F.lit(0)
        rank = F.struct(came.cast("long").alias("came"), F.col("_metadata.file_modification_time").alias("at"), F.xxhash64(*fields).alias("h"))
        return df.select("_id", F.struct(*fields).alias(name), rank.alias(f"{name}_rank"))

    s = side(stats, [f.name for f in STATS_SCHEMA.fields], "stats")
    c = side(crossref, [f.name for f in CROSSREF_SCHEMA.fields], "crossref")
    both = s.unionByName(c, allowMissingColumns=True)
    return both.groupBy("_id").agg(F.max_by("stats", "stats_rank").alias("stats"), F.max_by("crossref", "crossref_rank").alias("crossref"))


def sync_epoch(spark: SparkSession, changed: DataFrame, table: PapersTable, epoch: int, dim: int = 768, vectors: DataFrame | None = None,
               embedder: Callable | None = None, stream: str = "default") -> dict:
    """One micro-batch: rows (_id, stats, crossref) of the changed ids. Ids
    without a score row are no paper yet. Both rows of an id are side by side
    already, so nothing is joined again."""
    table.create_if_absent(papers_schema(dim))
    if table.applied(stream, epoch):
        return {"batch_id": epoch, "applied": False}
    there = F.col("crossref").isNotNull() & F.col("_id").isNotNull()  # as in a join, no id is like no id
    due = changed.where("stats IS NOT NULL").select("stats.*", F.when(there, F.col("crossref.publishedAt")).alias("_pub"),
                                                    F.when(there, F.col("crossref.raw_data")).alias("_raw"), F.when(there, True).alias("_has_crossref"))
    return sync_joined(due, table, epoch, dim, vectors, embedder, stream, skip_empty=True)


def start_stream_sync(spark: SparkSession, stats_dir: str, crossref_dir: str, table: PapersTable, checkpoint: str, dim: int = 768,
                      *, stream: str = "default", arrival: str | None = None, max_files_per_trigger: int | None = None,
                      processing_time: str | None = None, vectors: DataFrame | None = None,
                      embedder: Callable | None = None) -> StreamingQuery:
    """Incremental sync of both collections: new files in either folder are the
    stream (bibliographic rows with an ``arrival`` column, if named). Without
    ``processing_time`` the query ends when all files are done. ``query.stop()``
    stops it, ``query.status`` says whether it runs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = T.StructType([*CROSSREF_SCHEMA.fields, *([T.StructField(arrival, T.IntegerType())] if arrival else [])])

    def files(schema: T.StructType, path: str) -> DataFrame:
        source = spark.readStream.schema(schema)
        if max_files_per_trigger:
            source = source.option("maxFilesPerTrigger", max_files_per_trigger)
        return source.parquet(path)

    def each(batch: DataFrame, epoch: int) -> None:
        sync_epoch(batch.sparkSession, batch, table, epoch, dim, vectors, embedder, stream)

    changes = last_rows(files(STATS_SCHEMA, stats_dir), files(known, crossref_dir), arrival)
    writer = changes.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start()


class SyncRunner:
    """The background sync of one table: started, stopped and asked for its
    state by name. A table has one runner at a time: whoever starts creates a
    file that must not be there yet, in the store that holds the table."""

    def __init__(self, spark: SparkSession, stats_dir: str, crossref_dir: str, table: PapersTable, checkpoint: str, dim: int = 768, **options):
        self.spark, self.table, self.lock = spark, table, f"{table.base}/_runner"
        self.args, self.options, self.query = (stats_dir, crossref_dir, table, checkpoint, dim), options, None

    def start(self) -> bool:
        """False if a runner of this table is at work, here or elsewhere."""
        if not create_exclusive(self.spark, self.lock):
            return False
        try:
            self.query = start_stream_sync(self.spark, *self.args, **self.options)
        except BaseException:
            delete_path(self.spark, self.lock)
            raise
        return True

    def stop(self) -> bool:
        """Ends the sync after the batch at work; False if it isn't ours."""
        if self.query is None:
            return False
        self.query.stop()
        self.query = None
        return delete_path(self.spark, self.lock)

    def wait(self, seconds: float | None = None) -> bool:
        """Until all files are done (or time is up); raises what ended the stream."""
        return self.query is None or bool(self.query.awaitTermination(seconds) if seconds else self.query.awaitTermination() or True)

    def progress(self) -> DataFrame:
        """(epoch, at, rows, seconds) of the batches that the query remembers."""
        rows = [(int(p["batchId"]), str(p["timestamp"]), int(p["numInputRows"]), p["durationMs"].get("triggerExecution", 0) / 1000.0)
                for p in (self.query.recentProgress if self.query else [])]
        return self.spark.createDataFrame(rows, "epoch long, at string, rows long, seconds double")

    def status(self) -> DataFrame:
        """The totals of ``sync_status`` and whether this runner is at work."""
        return sync_status(self.table).withColumn("running", F.lit(self.query is not None and self.query.isActive))


__all__ = ["NO_CROSSREF", "SyncRunner", "recent_errors", "start_stream_sync", "sync", "sync_epoch", "sync_status"]
