"""Source access patterns: keyset page, deterministic sample, key lookup,
schema-typed reads of JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import checked_broadcast, cut_lineage

# Multiplier and modulus of the sampling hash (Knuth's
# multiplicative constant, the largest prime below 2^32).
HASH_MULT = 2654435761
HASH_MOD = 4294967291


def keyset_page(df: DataFrame, batch_size: int, last_id: str | None = None, key: str = "_id") -> DataFrame:
    """Rows with key > last_id (all when empty), ascending key, at most batch_size.

    Planned as TakeOrderedAndProject: each partition keeps its first
    ``batch_size`` rows, so a page never sorts the whole table.
    """
    out = df if not last_id else df.where(F.col(key) > F.lit(last_id))
    return out.orderBy(F.col(key).asc()).limit(batch_size)


def arithmetic_hash(k: Column, seed: int = 0) -> Column:
    """Portable 32-bit multiplicative hash of a non-negative integer key."""
    return F.pmod(k.cast("long") * F.lit(HASH_MULT) + F.lit(seed), F.lit(HASH_MOD))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: Column | None = None, tie: str = "_id") -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by a seeded hash order.

    ``key`` defaults to ``xxhash64(tie, seed)``; pass an integer key to get a
    hash that other engines can reproduce.
    """
    h = F.xxhash64(F.col(tie), F.lit(seed)) if key is None else arithmetic_hash(key, seed)
    return df.withColumn("_h", h).orderBy("_h", tie).limit(n).drop("_h")


def point_lookup(source: DataFrame, keys: DataFrame, key: str = "_id") -> DataFrame:
    """Batch form of a point lookup: every requested key, with the matching
    document or nulls. Of several rows of a source key one is taken, the same
    in every run; only rows of asked keys are compared."""
    asked = keys.select(key)
    known = source.join(asked.distinct(), key, "left_semi")
    return asked.join(newest_per_key(known, [key]), key, "left")


def newest_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the last by ``order``; without an order (and among
    ties) the one with the largest hash, the same in every run. Partial
    maxima are taken before the shuffle, so a hot key costs a row per task.
    Keys are those of the grouping, so a join by them moves no row again
    (numbers with a point stay the row's: a grouping takes -0.0 for 0.0)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*[F.col(f"`{c}`") for c in order or []], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_h"))
    grouped = [k for k in keys if isinstance(df.schema[k].dataType, (T.StringType, T.IntegralType, T.DateType, T.BinaryType))]
    return df.groupBy(*keys).agg(F.max_by(whole, rank).alias("_row")).select(
        *[F.col(f"`{c}`") if c in grouped else F.col("_row")[c].alias(c) for c in df.columns])


def one_per_key(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The rows of ``newest_per_key`` for one key, where only rows of repeated
    and of null keys are shuffled whole. ``df`` is read twice, by its keys first."""
    repeated = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key), "repeated_keys")
    if repeated.isEmpty():
        return df
    repeated = checked_broadcast(repeated, name="repeated_keys")
    null = df.where(F.col(key).isNull())
    return df.where(F.col(key).isNotNull()).join(repeated, key, "left_anti").select(df.columns).unionByName(
        newest_per_key(df.join(repeated, key, "left_semi").select(df.columns).unionByName(null), [key], order))


def read_json_payload(df: DataFrame, payload_col: str, schema: T.StructType) -> DataFrame:
    """Typed parse of string payloads: ``_parsed``, and ``parse_error`` for
    payloads that are not JSON of that shape (their ``_parsed`` is null, their
    raw text stays); such a row never fails the job."""
    wide = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json(F.col(payload_col), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = df.withColumn("_parsed", parsed)
    wrong = F.col(payload_col).isNotNull() & (F.col("_parsed").isNull() | F.col("_parsed._broken").isNotNull())
    out = out.withColumn("parse_error", wrong)
    whole = F.struct(*[F.col("_parsed")[f.name].alias(f.name) for f in schema.fields])
    return out.withColumn("_parsed", F.when(~F.col("parse_error") & F.col("_parsed").isNotNull(), whole))


def read_source_files(spark, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Any export of a source collection, read with the declared schema (no inference)."""
    return spark.read.schema(schema).format(fmt).load(path)
