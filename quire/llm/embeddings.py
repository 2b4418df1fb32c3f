"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors are normalised and rotated by one random orthogonal matrix. A code is
the signs of the rotated vector; with it is stored the correction factor
f = <code / sqrt(d), rotated vector>. Then <code / sqrt(d), rotated query> / f
is an unbiased estimate of the cosine, and its error is below
e * sqrt((1 - f^2) / (f^2 (d - 1))) but for a chance that falls with e like a
Gaussian tail. Pairs whose upper bound is below the threshold are settled by
that; all others are computed again in double precision, so no link is an
estimate.

Which pairs are looked at: every vector goes to its nearest cells around
centres drawn from the vectors; a pair is decided in the first cell the two
share. Centres are drawn by density, so those that one vector could link to are
thinned to one: a large group of near copies is one crowded cell, not hundreds
between which its pairs get lost. Where unrelated vectors are that close too,
for they share a common direction, only closer centres are thinned. The mean of
the centres that stay is taken off before cells are chosen, and the number of
cells of a vector follows from a trial: planted pairs at the threshold have to
meet. Equal vectors count as one with a multiplicity. A cell above ``TILE`` rows
is cut into segments, and every pair of segments is a piece of work of its own.
Cells emit counts of links per vector and a spanning forest, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, ship_by_value
from quire.llm.components import connected_components
from quire.llm.simhash import local_roots

#: Rows of a segment of a large cell, pairs computed again in one go: work sizes only.
TILE, PAIRS = 1024, 1 << 16
#: Vectors aimed at per cell, and the bound on cells (their centres are broadcast).
PER_CELL, MAX_CELLS = 128, 16384
#: Cells of a vector: at least, at most, and the share of planted pairs that has to meet.
PROBES, MOST_PROBES, MEETING = 6, 32, 0.98


def usable(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit_rows(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to ``dim``, and
    their own lengths."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None], lengths


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs, packed to bytes, and correction factors."""
    signs = rotated > 0
    factor = np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1])
    return np.packbits(signs, axis=1, bitorder="little"), factor.astype(np.float32)


def upper_bounds(codes: np.ndarray, factors: np.ndarray, rotated: np.ndarray, confidence: float) -> np.ndarray:
    """Upper confidence bounds of the cosines of coded rows and rotated queries."""
    dim = rotated.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim, bitorder="little").astype(np.float32) * 2 - 1
    estimate = (signs @ rotated.T) / (factors * np.float32(np.sqrt(dim)))[:, None]
    error = confidence * np.sqrt(np.maximum(1 - factors.astype(float) ** 2, 0) / (factors.astype(float) ** 2 * max(dim - 1, 1)))
    return estimate + (error + 1e-5).astype(np.float32)[:, None]


def spread_out(centres: np.ndarray, most: float) -> np.ndarray:
    """Positions of the centres that stay, in order: each whose cosine to all
    that stay before it is below ``most``."""
    kept = np.empty(0, np.int64)
    for at in range(0, len(centres), TILE):
        block = centres[at:at + TILE]
        free = np.ones(len(block), bool)
        for k in range(0, len(kept), TILE):
            free &= ~(block @ centres[kept[k:k + TILE]].T >= most).any(axis=1)
        close = block @ block.T >= most
        for i in range(len(block)):
            if free[i]:
                free[i + 1:] &= ~close[i, i + 1:]
        kept = np.r_[kept, at + np.flatnonzero(free)]
    return kept


def thinned(centres: np.ndarray, threshold: float) -> np.ndarray:
    """``centres`` without those that one vector could link to beside one that
    stays (the cosine of twice the angle). Should that leave less than half of
    them, unrelated vectors are as close as that or most rows are near copies:
    then the level is raised in steps, at most to ``threshold`` itself."""
    for most in np.linspace(max(2 * threshold ** 2 - 1, 0.0), threshold, 5):
        kept = spread_out(centres, most)
        if len(kept) * 2 >= len(centres):
            break
    return centres[kept]


def centred(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit directions of the centres from their mean, and the mean."""
    mean = centres.mean(axis=0)
    away = centres - mean
    return away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-6), mean


def nearest_cells(unit: np.ndarray, directions: np.ndarray, mean: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` cells of every row, in no order."""
    out = np.empty((len(unit), probes), np.int32)
    for at in range(0, len(unit), 256):
        score = (unit[at:at + 256] - mean) @ directions.T
        out[at:at + 256] = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
    return out


def probes_needed(centres: np.ndarray, threshold: float, seed: int, trials: int = 512) -> int:
    """The least number of cells by which MEETING of planted pairs share one:
    at most ``trials`` centres (their own cells don't count) and a partner of
    each at the threshold, away in the direction of another centre."""
    directions, mean = centred(centres)
    rng = np.random.default_rng(seed)
    own = rng.permutation(len(centres))[:trials]
    unit = centres[own]
    away = centres[rng.integers(0, len(centres), len(own))] - mean
    away -= np.einsum("ij,ij->i", away, unit)[:, None] * unit
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-6)
    most = min(MOST_PROBES, len(centres) - 1)
    order = []
    for rows in (unit, threshold * unit + np.sqrt(1 - threshold ** 2) * away):
        score = (rows - mean) @ directions.T
        score[np.arange(len(own)), own] = -np.inf
        best = np.argpartition(-score, max(most - 1, 0), axis=1)[:, :most]
        order.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, axis=1), axis=1), axis=1))
    for probes in range(min(PROBES, most), most):
        met = (order[0][:, :probes, None] == order[1][:, None, :probes]).any(axis=(1, 2))
        if met.mean() >= MEETING:
            return max(probes, PROBES)
    return max(most, PROBES)


class Cell:
    """Rows of one tile of a cell."""

    def __init__(self, number, segment, node, times, lists, code, factor, cells, turn):
        self.number, self.segment, self.node, self.times = number, segment, node, times
        self.unit, self.length = unit_rows(lists, turn.shape[0])
        self.code, self.factor, self.cells, self.turn = code, factor, cells, turn

    def links(self, threshold: float, confidence: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions (i, j) of linked rows whose first common cell is this one:
        pairs across the tile's two segments, or inside its only one."""
        rotated = self.unit.astype(np.float32) @ self.turn.T
        low = np.flatnonzero(self.segment == self.segment.min())
        high = np.flatnonzero(self.segment != self.segment.min())
        inside = not len(high)
        if inside:
            high = low
        bound = np.minimum(upper_bounds(self.code[low], self.factor[low], rotated[high], confidence),
                           upper_bounds(self.code[high], self.factor[high], rotated[low], confidence).T)
        a, b = np.nonzero(bound >= threshold)
        crowded = len(a) * 16 > bound.size  # then one product of matrices costs less than pair by pair
        if crowded:
            a, b = np.nonzero((bound >= threshold) & (self.unit[low] @ self.unit[high].T >= threshold))
        a, b = low[a], high[b]
        if inside:
            a, b = a[a < b], b[a < b]
        earlier = np.where(self.cells < self.number, np.uint64(1) << (self.cells % 64).astype(np.uint64), np.uint64(0))
        earlier = np.bitwise_or.reduce(earlier, axis=1)  # no common bit: no common cell before this one
        found_a, found_b = [], []
        for at in range(0, len(a), PAIRS):
            i, j = a[at:at + PAIRS], b[at:at + PAIRS]
            near = self.length[i] == self.length[j]
            if not crowded:
                near &= np.einsum("ij,ij->i", self.unit[i], self.unit[j]) >= threshold
            i, j = i[near], j[near]
            first = (earlier[i] & earlier[j]) == 0
            rest = np.flatnonzero(~first)
            ci, cj = self.cells[i[rest]], self.cells[j[rest]]
            first[rest] = ~((ci[:, :, None] == cj[:, None, :]).any(axis=2) & (ci < self.number)).any(axis=1)
            found_a.append(i[first])
            found_b.append(j[first])
        return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (a[:0], b[:0])


def embedding_links(vectors: DataFrame, dim: int, *, threshold: float = 0.9, probes: int | None = None,
                    confidence: float = 4.0, max_cells: int = MAX_CELLS, seed: int = 42) -> DataFrame:
    """(node, other, links) from (node, times, embedding): rows with a null
    ``other`` add to a node's number of links (times of the others), the rest
    are a spanning forest of the links.

    Centres are at most ``max_cells`` vectors, those with the smallest hashes:
    one for about PER_CELL vectors, but no two so close that one vector could
    link to both. Every vector is put into ``probes`` cells, by default as many
    as ``probes_needed`` finds.
    """
    spark = vectors.sparkSession
    wanted = int(min(max_cells, max(1, vectors.count() // PER_CELL)))
    centres = vectors.select("embedding", F.xxhash64("node", F.lit(seed)).alias("draw"), "node").orderBy("draw", "node").limit(wanted)
    drawn = centres.select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(drawn):
        return spark.createDataFrame([], "node long, other long, links long")
    centres = unit_rows(drawn, dim)[0].astype(np.float32)
    centres = thinned(centres, threshold)
    probes = min(probes or probes_needed(centres, threshold, seed), len(centres))
    shared = spark.sparkContext.broadcast((*centred(centres), rotation(dim, seed)))

    @F.arrow_udf("struct<code:binary,factor:float,cells:array<int>>")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        directions, mean, turn = shared.value
        for lists in batches:
            unit = unit_rows(lists, dim)[0].astype(np.float32)
            code, factor = encode(unit @ turn.T)
            cells = nearest_cells(unit, directions, mean, probes)
            offsets = np.arange(len(unit) + 1, dtype=np.int32)
            yield pa.StructArray.from_arrays(
                [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor),
                 pa.ListArray.from_arrays(pa.array(offsets * np.int32(probes)), pa.array(cells.ravel()))], ["code", "factor", "cells"])

    rows = cut_lineage(vectors.withColumn("at", placed("embedding")), "vector_codes")
    rows = rows.select("node", "times", "embedding", "at", F.explode("at.cells").alias("cell"))
    large = rows.groupBy("cell").count().where(F.col("count") > TILE).select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("segments"))
    rows = rows.join(large, "cell", "left")
    segment = F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.col("segments")), F.lit(0)).cast("int")
    count = F.coalesce("segments", F.lit(1))
    tiles = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.least(segment, j) * count + F.greatest(segment, j))
    rows = rows.select("cell", F.explode(tiles).alias("tile"), segment.alias("segment"), "node", "times", "embedding",
                       F.col("at.code").alias("code"), F.col("at.factor").alias("factor"), F.col("at.cells").alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value[2]

        def linked(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            column = {c: part[c].chunk(0) for c in part.column_names}
            node, times = column["node"].to_numpy(), column["times"].to_numpy()
            code = np.frombuffer(b"".join(column["code"].to_pylist()), np.uint8).reshape(len(node), -1)
            cells = column["cells"].flatten().to_numpy().reshape(len(node), -1)
            cell = Cell(column["cell"][0].as_py(), column["segment"].to_numpy(), node, times, column["embedding"], code,
                        column["factor"].to_numpy(), cells, turn)
            a, b = cell.links(threshold, confidence)
            links = np.bincount(a, weights=times[b], minlength=len(node)) + np.bincount(b, weights=times[a], minlength=len(node))
            root = local_roots(len(node), a, b)
            some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([
                pa.array(np.r_[node[some], node[moved]]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[root[moved]])]),
                pa.array(np.r_[links[some].astype(np.int64), np.zeros(len(moved), np.int64)])], ["node", "other", "links"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and (held[-1].column(0)[0] != batch.column(0)[a] or held[-1].column(1)[0] != batch.column(1)[a]):
                    yield linked(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield linked(pa.Table.from_batches(held))

    dealt = rows.repartition("cell", "tile").sortWithinPartitions("cell", "tile")
    return cut_lineage(dealt.mapInArrow(run, "node long, other long, links long"), "vector_links")


def embedding_near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
                              threshold: float = 0.9, **options) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    Rows link if their vectors' cosine in double precision is at least
    ``threshold`` (above 0); n_links counts the other rows linked directly,
    component_id is the smallest id reachable. Vectors that are null, zero or
    hold null or non-finite components, and vectors of different lengths, link
    with nothing. Null ids and repeated ids are rows like others; null ids are
    no component's name unless it has no other. Other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is to be above 0 and at most 1")
    src = df.select(F.col(id_col).alias("id"), F.when(usable(F.col(vector_col)), F.col(vector_col)).alias("embedding"))
    nodes = (src.where(F.col("embedding").isNotNull()).groupBy("embedding")
             .agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("least_id")).withColumn("node", F.monotonically_increasing_id()))
    nodes = cut_lineage(nodes, "vectors")
    dim = nodes.agg(F.max(F.size("embedding"))).first()[0] or 1
    links = embedding_links(nodes.select("node", "times", "embedding"), dim, threshold=threshold, **options)
    counts = links.where(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(links.where(F.col("other").isNotNull()), "node", "other")
    rooted = nodes.select("node", "times", "least_id").join(counts, "node", "left").join(roots, "node", "left")
    rooted = cut_lineage(rooted.withColumn("root", F.coalesce("root", "node")), "vector_roots")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    by_vector = nodes.select("node", F.col("embedding").alias("of")).join(found, "node")
    out = src.join(by_vector, src["embedding"] == by_vector["of"], "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


ship_by_value(__name__)
