"""Document fingerprints of closed syncmers.

A k-mer of code points is a closed syncmer if the least (by hash) of its inner
s-mers stands at its start or its end. Whether a k-mer is chosen depends on
the k-mer alone, so equal passages have equal anchors wherever they stand. A
fingerprint is the sequence of a text's anchors, each a 24-bit hash of the
k-mer and its distance from the anchor before; it is compared by position:
anchors match if their hashes do and another match stands on the same diagonal.
Short texts are read at a smaller scale; a pair of a short and a longer text is
compared by anchors of both at that scale.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ship_by_value, shuffle_partitions

#: Length s of inner substrings and how many w of them a k-mer has (k = s + w - 1),
#: for texts in general and for texts below SHORT code points.
LONG_SCALE, SHORT_SCALE, SHORT = (8, 24), (3, 6), 96
#: Code points, and texts, that are worked on in one go; work sizes only.
CHUNK, CHUNK_ROWS = 1 << 18, 1 << 13
_MULT = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MULT)
    return x ^ (x >> np.uint64(32))


def _hash_of_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")


def _sliding(x: np.ndarray, length: int, join) -> np.ndarray:
    """``join`` over every window of a length: windows of powers of two, then
    two of them that overlap."""
    width = 1
    while 2 * width <= length:
        x, width = join(x[:-width], x[width:], width), 2 * width
    return x if width == length else join(x[:width - length], x[length - width:], length)


def closed_syncmers(points: np.ndarray, s: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of code points: the
    k-mers whose first inner s-mer is the least of all, or whose last one is
    less than all others."""
    if len(points) < s + w - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    own = (points.astype(np.uint64) + np.uint64(1)) * _STEP
    own ^= own >> np.uint64(31)
    own = _sliding(own, s, lambda a, b, n: a * np.uint64(pow(_MULT, n, 1 << 64)) + b)
    order = (_mix(own) >> np.uint64(32)).astype(np.uint32)
    least = _sliding(order, w - 1, lambda a, b, n: np.minimum(a, b))  # of all inner s-mers but the last
    n = len(order) - w + 1
    first, last = order[:n], order[w - 1:]
    at = np.flatnonzero((first <= least[:n]) & (first <= last) | (last < least[:n]))
    whole = own[at]
    for inner in [*range(s, w - 1, s), w - 1]:
        whole = _mix(whole * _STEP + own[at + inner])
    return at, (whole >> np.uint64(32)).astype(np.uint32)


class Anchors:
    """Anchors of several texts: their text's number, position and 32-bit hash,
    ordered by text and position. Texts below SHORT code points (or all, if
    ``short``) are read at the short scale. A text too short to hold an anchor
    has a single one for all of it; an empty text has none."""

    def __init__(self, texts: list[str], short: bool = False):
        self.texts, self.source = len(texts), texts
        lengths = np.array([len(t) for t in texts], np.int64)
        self.short = (lengths < SHORT) | short
        parts = []
        for (s, w), members in ((LONG_SCALE, np.flatnonzero(~self.short)), (SHORT_SCALE, np.flatnonzero(self.short))):
            points = np.frombuffer("".join([texts[i] for i in members]).encode("utf-32-le", "surrogatepass"), np.uint32)
            at, value = closed_syncmers(points, s, w)
            ends = np.cumsum(lengths[members])
            own = np.searchsorted(ends, at, side="right")
            inside = at + s + w - 1 <= ends[own] if len(ends) else np.empty(0, bool)
            at, own, value = at[inside], own[inside], value[inside]
            parts.append((members[own], at - (ends - lengths[members])[own] if len(ends) else at, value))
        bare = np.setdiff1d(np.flatnonzero(lengths), np.concatenate([p[0] for p in parts]))
        parts.append((bare, np.zeros(len(bare), np.int64), np.array([_hash_of_text(texts[i]) for i in bare], np.uint32)))
        text, at, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        by_text = np.argsort(text, kind="stable")
        self.text, self.at, self.value = text[by_text], at[by_text], value[by_text]
        self.counts = np.bincount(text, minlength=len(texts))

    def strings(self) -> list[str]:
        """Fingerprints: base64 of a 32-bit little-endian number per anchor,
        24 bits of its hash and 8 of its distance from the one before (less
        than w; from the text's start for the first)."""
        gap = np.diff(self.at, prepend=0)
        starts = np.cumsum(self.counts) - self.counts
        heads = starts[self.counts > 0]
        gap[heads] = self.at[heads]
        records = ((self.value & np.uint32(0xFFFFFF00)) | np.minimum(gap, 255).astype(np.uint32)).astype("<u4").tobytes()
        return [base64.b64encode(records[4 * a:4 * (a + n)]).decode() for a, n in zip(starts.tolist(), self.counts.tolist(), strict=True)]

    def take(self, low: int, high: int) -> Anchors:
        """Texts low to high - 1, numbered from 0."""
        part = object.__new__(Anchors)
        a, b = np.searchsorted(self.text, (low, high))
        part.texts, part.counts = high - low, self.counts[low:high]
        part.source, part.short = self.source[low:high], self.short[low:high]
        part.text, part.at, part.value = self.text[a:b] - low, self.at[a:b], self.value[a:b]
        return part


def _keys(a: Anchors, b: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """A key per anchor of either side: equal if text, 24-bit hash and the
    number of equal ones before are. Hashes of texts are numbered first, so no
    count of texts or repeats outgrows its bits."""
    both = np.r_[a.text, b.text] << 24 | (np.r_[a.value, b.value] >> np.uint32(8)).astype(np.int64)
    kinds, kind = np.unique(both, return_inverse=True)
    out = []
    for own in (kind[:len(a.text)], kind[len(a.text):]):
        order = np.argsort(own, kind="stable")
        first = np.cumsum(np.bincount(own, minlength=len(kinds))) - np.bincount(own, minlength=len(kinds))
        number = np.empty(len(own), np.int64)
        number[order] = np.arange(len(own)) - first[own[order]]
        out.append(number * max(len(kinds), 1) + own)  # below anchors squared
    return out[0], out[1]


def likeness(a: Anchors, b: Anchors) -> np.ndarray:
    """From 0 to 1 for each pair of texts with one number: the share of their
    anchors that match by hash and stand on a diagonal with another match (if
    either text has one anchor only, by hash). If one text is read at the short
    scale, both are. Two empty texts: 1."""
    out = _likeness(a, b)
    mixed = np.flatnonzero((a.short != b.short) & (a.counts > 0) & (b.counts > 0))
    if len(mixed):
        out[mixed] = _likeness(Anchors([a.source[i] for i in mixed], short=True), Anchors([b.source[i] for i in mixed], short=True))
    return out


def _likeness(a: Anchors, b: Anchors) -> np.ndarray:
    """The same by the anchors as they are."""
    ka, kb = _keys(a, b)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    text, diagonal = a.text[ia], a.at[ia] - b.at[ib]
    _, group, votes = np.unique(np.stack([text, diagonal]), axis=1, return_inverse=True, return_counts=True) if len(ia) else (0, ia, ia)
    both = a.counts + b.counts
    few = np.minimum(a.counts, b.counts) < 2
    good = (votes[group.ravel()] > 1) | few[text] if len(ia) else np.empty(0, bool)
    matched = np.bincount(text[good], minlength=a.texts)
    return np.where(both == 0, 1.0, 2.0 * matched / np.maximum(both, 1))


def with_tail_of_next(text: str, following: str) -> str:
    """The last quarter (rounded down) gives way to the next text's first code
    points, as many or all."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


RESULT = "id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, ahead, id, text) in order; a row's next is the row after it
    in its range, and rows ahead are there only to be next."""
    held: list[tuple] = []

    def work(rows: list[tuple]) -> pa.RecordBatch:
        own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        texts = [r[3] for r in rows]
        edited = [with_tail_of_next(texts[i], texts[i + 1]) for i in own]
        a, e = Anchors(texts), Anchors(edited)
        prints = a.strings()
        near_next = likeness(a.take(0, len(rows) - 1), a.take(1, len(rows)))
        near_edited = likeness(Anchors([texts[i] for i in own]) if len(own) < len(rows) - 1 else a.take(0, len(own)), e)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in own], ids), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array([prints[i] for i in own], pa.string()), pa.array(e.strings(), pa.string()),
            pa.array(near_edited, pa.float64()), pa.array(near_next[own], pa.float64())],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    size = 0
    for batch in batches:
        ids = batch.schema.field("id").type
        for row in zip(*(batch.column(n).to_pylist() for n in ("range", "ahead", "id", "text")), strict=True):
            held.append(row)
            size += len(row[3])
            if (size >= CHUNK or len(held) > CHUNK_ROWS) and len(held) > 1:
                yield work(held)
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield work(held)


def fingerprints_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last quarter is taken from the next
    one's start, in ascending order of id (an integer; nulls first; rows with
    one id by their text); after the last comes the first. Null texts count as
    empty. Rows of one id, or of none, are one range, which streams through a
    task in blocks of bounded size. No rows: no rows. Other columns of ``df`` are not read.

    Rows go to ranges of ids with boundaries at approximate quantiles; the
    first row of every range goes to the range before as well, so every row
    meets its next in one shuffle of the texts and without a global window.
    On the driver are one boundary and one first id per range.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("place", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))))
    ranges = 4 * shuffle_partitions(spark)
    quantiles = F.percentile_approx("place", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 20 * ranges)
    bounds = np.unique(np.array(src.agg(quantiles).first()[0] or [], np.int64))

    @F.arrow_udf("int")
    def range_of(place: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, place.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    firsts = src.select("place").withColumn("range", range_of("place")).groupBy("range").agg(F.min("place").alias("first")).orderBy("range").collect()
    first, at = np.array([r["first"] for r in firsts], np.int64), np.array([r["range"] for r in firsts], np.int32)

    @F.arrow_udf("array<int>")
    def ranges_of(place: pa.Array) -> pa.Array:
        place = place.to_numpy(zero_copy_only=False)
        own = np.searchsorted(first, place, side="right") - 1
        both = np.stack([at[own], at[own - 1]], axis=1).ravel()
        offsets = np.r_[0, np.cumsum(1 + (first[own] == place))]
        keep = np.ones(len(both), bool)
        keep[1::2] = first[own] == place
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(both[keep]))

    rows = src.select("id", "text", "place", F.posexplode(ranges_of("place")).alias("ahead", "range"))
    rows = rows.repartition("range").sortWithinPartitions("range", "ahead", "place", "id", "text").select("range", "ahead", "id", "text")
    id_type = src.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_rows, RESULT.format(id=id_type))


ship_by_value(__name__)
