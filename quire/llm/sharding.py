"""Sharding by sampled splitters: shards of near equal bytes.

Rows are ordered by (hash of the text, id), so equal texts stand together. A
size-weighted sample of those keys gives boundaries at quantiles; rows are
partitioned by range; ranges whose exact size is over twice the mean are
subdivided with splitters from a denser sample of their own, so neither one
text with very many copies nor an unlucky sample makes a large range. Exact
sums of the ranges and running sums inside each then give every row its place
in the whole, and shards are cut at equal places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, ship_by_value

#: Sampled keys per range, and rows per range aimed at beyond RANGES_PER_SHARD:
#: the number of splitters on the driver is the number of rows over ROWS_PER_RANGE.
OVERSAMPLE, RANGES_PER_SHARD, ROWS_PER_RANGE = 32, 16, 500_000


def range_numbers(hashes: np.ndarray, ties: np.ndarray, split_hash: np.ndarray, split_tie: np.ndarray) -> np.ndarray:
    """How many splitters (sorted by hash, then tie) are at or below each key."""
    low = np.searchsorted(split_hash, hashes, side="left")
    high = np.searchsorted(split_hash, hashes, side="right")
    out = low.copy()
    for at in np.unique(low[low < high]):  # keys whose hash is a splitter's
        rows = np.flatnonzero((low == at) & (low < high))
        out[rows] = at + np.searchsorted(split_tie[at:high[rows[0]]], ties[rows], side="right")
    return out


def quantile_splitters(sample: np.ndarray, parts: int) -> np.ndarray:
    """parts - 1 boundaries of near equal weight from rows (hash, tie, weight)."""
    sample = sample[np.lexsort((sample["tie"], sample["hash"]))]
    upto = np.cumsum(sample["weight"])
    return sample[np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)] if len(sample) else sample


def _sampled(rows: DataFrame, bytes_per_key: float, seed: int) -> np.ndarray:
    """Keys drawn with probability size / bytes_per_key, at most 1; the weight
    of a key is the bytes it stands for."""
    # a hash's upper 53 bits as a number in [0, 1): the same rows in each run
    u = F.shiftrightunsigned(F.xxhash64("hash", "tie", "size", F.lit(seed)), 11).cast("double") / float(1 << 53)
    few = rows.where(u < F.col("size") / F.lit(float(bytes_per_key))).select("hash", "tie", F.greatest("size", F.lit(float(bytes_per_key))).alias("weight"))
    found = few.toArrow()
    out = np.empty(found.num_rows, [("hash", np.int64), ("tie", np.int64), ("weight", float)])
    for c in out.dtype.names:
        out[c] = found[c].to_numpy()
    return out


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    split_hash, split_tie = splitters["hash"].copy(), splitters["tie"].copy()

    @F.arrow_udf("int")
    def number(hashes: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(range_numbers(hashes.to_numpy(), ties.to_numpy(), split_hash, split_tie).astype(np.int32))

    return rows.withColumn("range", number("hash", "tie"))


def choose_splitters(rows: DataFrame, total: int, ranges: int, seed: int = 42, whole: float = 0.0) -> tuple[np.ndarray, list[int]]:
    """Sampled boundaries, and the hashes that they may cut. Overfull ranges
    are subdivided until none is left with a key to cut at. Boundaries lie
    between texts; only a text whose copies have more bytes than a range, and
    more than ``whole``, is cut inside: at most as many texts as ranges."""
    mean = max(total / ranges, 1.0)
    between = -(2**63)
    splitters = quantile_splitters(_sampled(rows, mean / OVERSAMPLE, seed), ranges)[["hash", "tie"]].copy()
    splitters["tie"] = between
    splitters, heavy, attempt = np.unique(splitters), np.empty(0, np.int64), 0
    while True:
        attempt += 1
        sizes = _ranged(rows, splitters).groupBy("range").agg(F.sum("size").alias("bytes"))
        over = [(r["range"], r["bytes"]) for r in sizes.where(F.col("bytes") > 2 * mean).collect()]
        if not over:
            break
        inside = _ranged(rows, splitters).where(F.col("range").isin([r for r, _ in over]))
        many = inside.groupBy("hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > max(mean, whole))
        heavy = np.union1d(heavy, many.select("hash").toArrow()["hash"].to_numpy())
        sample = _sampled(inside, mean / OVERSAMPLE, seed + attempt)
        at = range_numbers(sample["hash"], sample["tie"], splitters["hash"].copy(), splitters["tie"].copy())
        more = np.concatenate([quantile_splitters(sample[at == r], int(np.ceil(size / mean)) + 1)[["hash", "tie"]] for r, size in over])
        more["tie"][~np.isin(more["hash"], heavy)] = between
        wider = np.unique(np.concatenate([splitters, more]))
        if len(wider) == len(splitters):
            break
        splitters = wider
    return splitters, heavy.tolist()


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 16,
                   seed: int = 42, together: float = 0.02) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``df``.

    size is the text's UTF-8 bytes (null: none) plus 1; shards are ranges of
    keys of near equal bytes; slots count a shard's rows from 0. Copies of a
    text stay in one shard if together they have at most ``together`` of a
    shard's bytes, else they are split like other rows. Null texts count as
    empty, ids (integers) may be null or repeat; rows with the same id and text are
    interchangeable. Other columns are not read. No rows: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
                     F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("tie"))
    rows = cut_lineage(rows, "shard_keys")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-count // ROWS_PER_RANGE))
    share = max(total / shards, 1.0)
    splitters, heavy = choose_splitters(rows, total, ranges, seed, together * share)
    ranged = cut_lineage(_ranged(rows, splitters), "shard_ranges")

    # one row per range, as many as there are splitters
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
                         F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    in_order = W.partitionBy("range").orderBy("hash", "tie", "size")
    copies = W.partitionBy("range", "hash")
    placed = ranged.withColumn("number", F.row_number().over(in_order))
    placed = placed.withColumn("before", F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("group_bytes", F.sum("size").over(copies)).withColumn("group_before", F.min("before").over(copies))
    placed = placed.join(starts, "range")
    middle = F.when((F.col("group_bytes") <= together * share) & ~F.col("hash").isin(heavy), F.col("group_before") + F.col("group_bytes") / 2).otherwise(
        F.col("before") + F.col("size") / 2)
    shard = F.least(F.floor((F.col("bytes_before") + middle) / share), F.lit(shards - 1)).cast("int")
    placed = placed.select("id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("number") - 1).alias("place"))
    placed = cut_lineage(placed, "shard_places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


ship_by_value(__name__)
