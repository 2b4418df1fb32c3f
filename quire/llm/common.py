"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions._ship import ship_by_value
from quire.session import cut_lineage, shared_path

__all__ = ["cut_lineage", "shared_path", "ship_by_value", "apply_llm_conf", "table", "WORDS", "word_count",
           "null_safe_join", "shuffle_partitions"]

#: Words are runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"

#: Texts may be very long, so Arrow batches are bounded by bytes as well as by
#: rows. This is session-wide and changes no result.
LLM_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def apply_llm_conf(spark: SparkSession) -> None:
    for key, value in LLM_CONF.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str) -> DataFrame:
    """Equi-join in which null keys meet null keys; the left side's keys stay."""
    keys = list(keys)
    renamed = right.select(*[F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        cond = left[k].eqNullSafe(renamed[f"__right_{k}"])
        on = cond if on is None else on & cond
    out = left.join(renamed, on, how)
    return out.drop(*[f"__right_{k}" for k in keys])
