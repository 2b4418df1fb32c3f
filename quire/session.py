"""Spark session and shared-storage helpers.

On a cluster the session is created by the platform; we only read its
settings. ``local_session`` is for tests and benchmarks on one machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. Dates are compared as calendar values, so the
# session time zone is pinned to UTC; ANSI mode stays on (Spark 4 default) and
# the code uses try_* / get() wherever dirty input could raise.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The mapping is one wide projection of large text expressions; constraint
    # inference over it costs seconds of planning and infers nothing useful
    # (join keys are filtered explicitly).
    "spark.sql.constraintPropagation.enabled": "false",
    # Tables bucketed by document are joined on (request, document) where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Papers, batches and indexes are texts twice over: zstd stores them in
    # less than the default codec does, and every Spark reads it.
    "spark.sql.parquet.compression.codec": "zstd",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # one machine, small files: let file scans split by core count instead
        # of packing every small file into one task
        .config("spark.sql.files.openCostInBytes", str(64 * 1024))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", str(256 * 1024))
    )
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Runtime-settable SQL options; safe to call on a session we did not build."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # pragma: no cover - static conf on some deployments
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it. Only a local session, where it may be unset, gets a
    scratch folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        d = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the shared checkpoint folder (cluster-visible)."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base, *parts, uuid.uuid4().hex])


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """The shuffle files of a write go when it is done, not when the driver
    happens to collect its garbage: what was written is never computed again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: lineage is cut, the data survives executor loss (never a
    local checkpoint), and later stages get column pruning and real size
    statistics for their join decisions."""
    path = shared_path(df.sparkSession, "stages", name)
    with dropping_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Deletes a folder in whatever store it is; False if there was none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    return bool(store.exists(at) and store.delete(at, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(conf).exists(at))


def create_exclusive(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if it's there already (one store call, so
    of two that try one succeeds)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    try:
        store.create(at, False).close()
    except Exception:  # what Java raises differs between stores
        if not store.exists(at):
            raise
        return False
    return True


MAX_BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES, name: str = "broadcast_side"):
    """Materialise a request-derived table once (shared folder) and mark it
    for broadcast only when its rows, measured as text, are within the bound;
    otherwise the join stays a shuffle join (AQE splits skewed partitions).
    The rows are the same either way."""
    frozen = cut_lineage(df, name)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in frozen.columns])))
    return F.broadcast(frozen) if (frozen.agg(F.sum(size)).first()[0] or 0) <= max_bytes else frozen
