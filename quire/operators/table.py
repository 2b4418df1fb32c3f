"""Keyed upserts into a ``papers`` table on plain Parquet.

Layout under ``base``:
  _schema/               an empty file set with the declared schema
  data/batch=<name>/     the rows of one batch, each with the batch's ``_seq``
  rejects/batch=<name>/  what the batch turned away
  log/                   one row per applied batch, written last
  published/name=<name>/ the state that a name stands for, see ``publish``

A batch is appended, so its cost follows the batch; the newest row of a key
wins when the table is read. ``compact`` folds all batches into one. A batch
counts once its row is in the log: folders without one are never read and are
overwritten when the batch is tried again. Readers see all applied batches, or
the state that was published under a name. The log knows batches by (stream,
batch id), so a replayed batch changes nothing, whatever else was applied
since, and two streams never stand in each other's way. One writer per table.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.quality import is_protected_name
from quire.session import delete_path, path_exists
from quire.sources.scan import newest_per_key, one_per_key

LOG_DDL = ("stream string, batch_id long, batch string, seq long, kind string, last_id string, retrieved long, indexed long, "
           "created long, updated long, rejected long, started_at timestamp, ended_at timestamp, map_s double, write_s double")
PUBLISHED_DDL = "name string, seq long, base long, at timestamp"
#: Batches after which an upsert folds the table, to bound what a read merges.
COMPACT_AFTER = 32


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass
class UpsertResult:
    seq: int
    applied: bool
    created: int
    updated: int


class PapersTable:
    def __init__(self, spark: SparkSession, base: str, key: str = "id", compact_after: int = COMPACT_AFTER):
        self.spark, self.base, self.key, self.compact_after = spark, base.rstrip("/"), key, compact_after
        self._schema: T.StructType | None = None

    # --------------------------------------------------------------- state
    def exists(self) -> bool:
        return self._schema is not None or path_exists(self.spark, f"{self.base}/_schema")

    def create_if_absent(self, schema: T.StructType) -> None:
        """An empty table with the declared schema."""
        if not self.exists():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.base}/_schema")
            self._schema = schema

    def schema(self) -> T.StructType:
        if self._schema is None:
            self._schema = self.spark.read.parquet(f"{self.base}/_schema").schema
        return self._schema

    def log(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.base}/log"):  # nothing applied yet
            return self.spark.createDataFrame([], LOG_DDL)
        return self.spark.read.schema(LOG_DDL).parquet(f"{self.base}/log")

    def _state(self, stream: str = "", batch_id: int | None = None) -> tuple[int, int, bool]:
        """(last seq, seq of the last compaction, whether the batch is applied)."""
        own = (F.col("stream") == stream) & (F.col("batch_id") == batch_id) if batch_id is not None else F.lit(False)
        zero = F.lit(0).cast("long")
        return tuple(self.log().agg(F.coalesce(F.max("seq"), zero), F.coalesce(F.max(F.when(F.col("kind") == "base", F.col("seq"))), zero),
                                    F.coalesce(F.bool_or(own), F.lit(False))).first())

    def _live(self, since: int | None = None, upto: int | None = None) -> list[tuple[str, int]]:
        """(batch, seq) from the last compaction on: at most compact_after + 1."""
        since = self._state()[1] if since is None else since
        own = (F.col("seq") >= since) & (F.col("seq") <= upto if upto is not None else F.lit(True))
        return [(r["batch"], r["seq"]) for r in self.log().where(own).select("batch", "seq").collect()]

    def applied(self, stream: str, batch_id: int | None) -> bool:
        return batch_id is not None and self._state(stream, batch_id)[2]

    def _rows(self, live: list[tuple[str, int]]) -> DataFrame:
        schema = T.StructType([*self.schema().fields, T.StructField("_seq", T.LongType())])
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/data/batch={b}" for b, _ in live])

    def publish(self, name: str) -> int:
        """From now on ``read(name)`` gives the table as it is now, whatever is
        applied later, until the name is published again."""
        if is_protected_name(name) or not re.fullmatch(r"[\w-]+", name):
            raise PermissionError(f"not a name for a published state: {name!r}")
        last, base, _ = self._state()
        rows = self.spark.createDataFrame([(name, last, base, now())], PUBLISHED_DDL)
        rows.drop("name").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/published/name={name}")
        return last

    def published(self) -> DataFrame:
        """(name, seq, base, at) of the published states."""
        if not path_exists(self.spark, f"{self.base}/published"):
            return self.spark.createDataFrame([], PUBLISHED_DDL)
        return self.spark.read.schema(PUBLISHED_DDL).parquet(f"{self.base}/published")

    def read(self, name: str | None = None) -> DataFrame:
        """The newest row of every key: of all applied batches, or of the state
        published as ``name``."""
        if name is None:
            live = self._live()
        else:
            at = self.published().where(F.col("name") == name).select("base", "seq").first()
            if at is None:
                raise LookupError(f"nothing is published as {name!r}")
            live = self._live(at["base"], at["seq"])
        rows = self._rows(live)
        return (rows if len(live) < 2 else newest_per_key(rows, [self.key], ["_seq"])).drop("_seq")

    # -------------------------------------------------------------- upsert
    def upsert(self, batch: DataFrame, batch_id: int | None = None, order: list[str] | None = None, *, stream: str = "default",
               rejects: DataFrame | None = None, facts: dict | None = None) -> UpsertResult:
        """Whole-document replace keyed by ``key``; insert when new.

        Of several rows of a key the last by ``order`` wins. A vector column
        whose schema metadata names a dimension takes vectors of that
        dimension only: others become null. ``facts`` are further log columns.
        Only rows of repeated keys are shuffled: ``batch`` is read for its keys
        first, so cut its lineage if it is costly or may differ between reads.
        """
        started = now()
        last, base, applied = self._state(stream, batch_id)
        if applied:
            return UpsertResult(0, False, 0, 0)
        live, seq = self._live(base), last + 1
        name = re.sub(r"\W", "_", stream) + (f"-{batch_id:012d}" if batch_id is not None else f"-x{uuid.uuid4().hex}")
        rows = one_per_key(batch, self.key, order).select(*[self._checked(f).alias(f.name) for f in self.schema().fields], F.lit(seq).alias("_seq"))
        path = f"{self.base}/data/batch={name}"
        rows.write.mode("overwrite").parquet(path)
        if rejects is not None:
            rejects.write.mode("overwrite").parquet(f"{self.base}/rejects/batch={name}")
        own = self.spark.read.parquet(path).select(self.key)
        if live:
            old = self._rows(live).select(self.key).distinct().withColumn("_old", F.lit(1))
            total, updated = own.join(old, self.key, "left").agg(F.count(F.lit(1)), F.count("_old")).first()
        else:
            total, updated = own.count(), 0
        row = {"stream": stream, "batch_id": batch_id, "batch": name, "seq": seq, "kind": "batch", "created": total - updated,
               "updated": updated, "started_at": started, "ended_at": now(), **(facts or {})}
        row["write_s"] = (row["ended_at"] - started).total_seconds()
        self._append(row)
        if len(live) + 1 > self.compact_after:
            self.compact()
        return UpsertResult(seq, True, total - updated, updated)

    def _checked(self, field: T.StructField):
        value = F.col(field.name).cast(field.dataType)
        dim = (field.metadata or {}).get("dim")
        return value if dim is None else F.when(F.size(value) == dim, value)

    def _append(self, row: dict) -> None:
        schema = self.spark.createDataFrame([], LOG_DDL).schema
        self.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema).coalesce(1).write.mode("append").parquet(f"{self.base}/log")

    def compact(self) -> None:
        """Folds all batches into one folder. Folders of before the last
        compaction but one are deleted: a reader may still be on the others."""
        live = self._live()
        if len(live) < 2:
            return
        # only what lies between the last two compactions and no published state reads: earlier folders are gone
        last_base = self._state()[1]
        before = self.log().where((F.col("kind") == "base") & (F.col("seq") < last_base)).agg(F.max("seq")).first()[0] or 0
        kept = {b for p in self.published().collect() for b, _ in self._live(p["base"], p["seq"])}
        old = [r for r in self.log().where((F.col("seq") >= before) & (F.col("seq") < last_base)).select("batch").collect() if r["batch"] not in kept]
        seq = max(s for _, s in live) + 1
        name = f"base-{seq:012d}"
        self.read().withColumn("_seq", F.lit(seq)).write.mode("overwrite").parquet(f"{self.base}/data/batch={name}")
        self._append({"stream": "", "batch": name, "seq": seq, "kind": "base", "started_at": now(), "ended_at": now()})
        for r in old:
            delete_path(self.spark, f"{self.base}/data/batch={r['batch']}")

    def rejects(self) -> DataFrame:
        """Reject rows of the applied batches with their batch."""
        if not path_exists(self.spark, f"{self.base}/rejects"):
            return self.spark.createDataFrame([], "id string, reason string, batch string")
        found = self.spark.read.option("basePath", f"{self.base}/rejects").parquet(f"{self.base}/rejects")
        return found.join(self.log().select("batch"), "batch", "left_semi")

    def drop(self) -> bool:
        return drop_table(self.spark, self.base)


def drop_table(spark: SparkSession, path: str, name: str | None = None) -> bool:
    """Drop by name; protected names are refused; a missing table is a soft result (False)."""
    if name is not None and is_protected_name(name):
        raise PermissionError(f"refusing to drop protected table {name!r}")
    return delete_path(spark, path)
