"""SimHash near-duplicates, compared bit-sliced.

1. ``simhash_fingerprints``: per document the 64-bit majority of the XXH64
   hashes of its word shingles (whole text, repeats included).
2. ``simhash_links``: distinct fingerprints only. 64 bits are cut into
   ``max_bits + 2`` blocks; two fingerprints within ``max_bits`` agree in at
   least two blocks, so joining on every pair of blocks finds every link.
   Buckets are compared bit-sliced: bit planes stand vertically, one lane per
   fingerprint, and carry-save bitwise counters add up 64 distances per word
   operation; lanes' words are abandoned once all of them exceed the radius.
   A bucket emits a spanning forest of its links, never all its pairs. A
   bucket above ``TILE`` rows is cut into segments and each pair of segments
   is a task's work of its own, so no group has to fit one task.
3. ``simhash_components``: connected components of those links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, ship_by_value
from quire.llm.components import connected_components

#: Rows of one segment of a hot bucket; a work size, nothing is dropped.
TILE = 4096
#: Sorted rows that are compared in one go.
BLOCK_ROWS = 1 << 16


# ---- fingerprints -----------------------------------------------------------------

def shingle_hashes(text: str, words_per_shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the text, A-Z lower-cased, as uint64."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    k, digest = words_per_shingle, xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b - 1], seed) for a, b in zip(ends, ends[k:], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half the hashes; none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[at:at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                         words_per_shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp): fp is the fingerprint's 64 bits as a signed long;
    text_hash (XXH64 of the text) tells rows with one id apart. Null text and
    text without words: fingerprint 0."""
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [0 if t is None else majority(shingle_hashes(t, words_per_shingle)) for t in batch.column(2).to_pylist()]
            fp = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["id", "text_hash", "fp"])

    return src.mapInArrow(run, f"id {id_type}, text_hash long, fp long")


# ---- bit-sliced comparison ----------------------------------------------------------

def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit p of lane i is bit i % 64 of word i // 64 of plane p."""
    lanes = -(-len(prints) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def lane_mask(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[:len(packed)] = packed
    return out.view(np.uint64)


def _shifted(planes: np.ndarray, words: np.ndarray, by: int) -> np.ndarray:
    """Lane i + by of the planes at lane i, for the given words only."""
    skip, bit = divmod(by, 64)
    last = planes.shape[1] - 1
    low = np.where(words + skip <= last, planes[:, np.minimum(words + skip, last)], np.uint64(0))
    if not bit:
        return low
    high = np.where(words + skip + 1 <= last, planes[:, np.minimum(words + skip + 1, last)], np.uint64(0))
    return (low >> np.uint64(bit)) | (high << np.uint64(64 - bit))


def lanes_within(planes: np.ndarray, by: int, alive: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """Lanes i (of those alive) whose Hamming distance to lane i + by is at
    most ``radius``. Carry-save counters start so that they overflow exactly
    when a distance passes the radius; words whose lanes all did are dropped."""
    words = np.flatnonzero(alive)
    over = ~alive[words]
    width = int(radius).bit_length()
    preset = (1 << width) - 1 - radius
    counters = [np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF) if preset >> k & 1 else np.uint64(0)) for k in range(width)]
    for at in range(0, 64, step):
        if not len(words):
            break
        part = planes[at:at + step]
        differing = part[:, words] ^ _shifted(part, words, by)
        for carry in differing:
            for k in range(width):
                carried = counters[k] & carry
                counters[k] ^= carry
                carry = carried
            over |= carry
        live = np.flatnonzero(~over)
        if len(live) < len(words):
            words, over, counters = words[live], over[live], [c[live] for c in counters]
    if not len(words):
        return np.empty(0, np.int64)
    bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            hop = label[label]
            if (hop == label).all():
                break
            label = hop
        rest = label[a] != label[b]
        if not rest.any():
            break
        a, b = a[rest], b[rest]
    return label


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def forest_of_buckets(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (pairs of fingerprints) of the links inside each run of
    equal keys."""
    _, lengths = run_lengths(keys)
    keep = np.repeat(lengths, lengths) >= 2
    prints, size = prints[keep], np.repeat(lengths, lengths)[keep]
    keys = keys[keep]
    if not len(prints):
        return prints, prints
    order_in = np.arange(len(prints))
    found_a, found_b, found = [], [], 0
    lanes, by, limit = order_in, 1, 4
    while len(lanes):
        own = prints[lanes]
        planes = bit_planes(own)
        starts, runs = run_lengths(keys[lanes])
        left = np.repeat(starts + runs, runs) - np.arange(len(lanes))  # lanes from here to the end of the run
        top = int(runs.max())
        while by < min(top, limit):
            hit = lanes_within(planes, by, lane_mask(left > by, planes.shape[1]), radius)
            if len(hit):
                found_a.append(lanes[hit])
                found_b.append(lanes[hit + by])
                found += len(hit)
                if found > 1 << 20:  # keep a forest only
                    root = local_roots(len(prints), np.concatenate(found_a), np.concatenate(found_b))
                    moved = np.flatnonzero(root != order_in)
                    found_a, found_b, found = [moved], [root[moved]], len(moved)
            by += 1
        lanes = lanes[size[lanes] > by]
        limit *= 4
    if not found_a:
        return prints[:0], prints[:0]
    root = local_roots(len(prints), np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(root != order_in)
    return prints[moved], prints[root[moved]]


def block_layout(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the max_bits + 2 blocks that make up 64 bits."""
    n = max_bits + 2
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def simhash_links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b) pairs of distinct fingerprints ``fp`` that connect all
    fingerprints within ``max_bits`` of each other (a spanning forest per
    bucket; its components are those of all links)."""
    if not 0 <= max_bits <= 30:
        raise ValueError("max_bits is to be from 0 to 30")
    fp = F.col("fp")
    part = [F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for shift, width in block_layout(max_bits)]
    wide = max(w for _, w in block_layout(max_bits))
    keys = [F.xxhash64(F.lit(i), F.shiftleft(part[a], wide).bitwiseOR(part[b])) for i, (a, b) in enumerate(combinations(range(len(part)), 2))]
    # the key of a bucket is a hash of (blocks, bits): a collision only adds comparisons
    rows = prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("bucket"))
    hot = rows.groupBy("bucket").count().where(F.col("count") > TILE).select("bucket", F.ceil(F.col("count") / TILE).cast("int").alias("segments"))
    rows = rows.join(hot, "bucket", "left")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("segments")).cast("int")
    tiles = F.when(F.col("segments").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("segments") - 1),
                    lambda j: F.least(own, j) * F.col("segments") + F.greatest(own, j)))
    rows = rows.select(F.explode(tiles).alias("tile"), "bucket", "fp").select(F.xxhash64("bucket", "tile").alias("bucket"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys, prints):
            a, b = forest_of_buckets(keys, prints.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held_k, held_f = [], []
        for batch in batches:
            held_k.append(batch.column(0).to_numpy())
            held_f.append(batch.column(1).to_numpy())
            if sum(map(len, held_k)) >= BLOCK_ROWS:
                keys, prints = np.concatenate(held_k), np.concatenate(held_f)
                cut = int(np.flatnonzero(keys == keys[-1])[0])  # sorted: the last bucket may go on
                if cut:
                    yield links(keys[:cut], prints[:cut])
                held_k, held_f = [keys[cut:]], [prints[cut:]]
        if held_k and sum(map(len, held_k)):
            yield links(np.concatenate(held_k), np.concatenate(held_f))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def simhash_components(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of ``prints`` (id,
    fp); component_id is the smallest id reachable over links (null ids don't
    count; null if there is no other)."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = connected_components(simhash_links(prints, max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted, "simhash_roots")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def simhash_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                            words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, text_hash, fp, component_id), a row for every row of ``df``.

    Null and empty texts have fingerprint 0 and link like any other. Repeated
    rows come out as often as they went in. Other columns of ``df`` are not
    read. An empty table gives an empty result.
    """
    prints = cut_lineage(simhash_fingerprints(df, id_col, text_col, words_per_shingle=words_per_shingle), "simhash")
    return prints.join(simhash_components(prints, max_bits), "fp").select("id", "text_hash", "fp", "component_id")


def keep_one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                           words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``df`` without near-duplicates: of each component the row with the
    smallest id stays (then the smallest text hash; of equal rows one). All
    columns are kept as they are."""
    found = simhash_near_duplicates(df, id_col, text_col, words_per_shingle=words_per_shingle, max_bits=max_bits)
    # keys without nulls: the join and the removal of repeated rows then share one shuffle of the texts
    key = [F.col("id").isNull().alias("no_id"), F.coalesce(F.col("id"), F.lit(0).cast(found.schema["id"].dataType)).alias("some_id"), F.col("text_hash")]
    names = ["no_id", "some_id", "text_hash"]
    # a component is named by its smallest id, or by fingerprint where all its ids are null
    name = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = found.groupBy("component_id", name.alias("fp")).agg(F.min(F.struct(*key)).alias("row")).select("row.*").distinct()
    boxed = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # so no name can clash
    marked = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), boxed.alias("row")).select(*key, "row")
    own = marked.join(kept, names, "left_semi").dropDuplicates(names)
    return own.select(*[F.col("row")[c].alias(c) for c in df.columns])


ship_by_value(__name__)
