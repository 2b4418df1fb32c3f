"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds
cut the score into grades: P(grade >= k) = sigmoid(score - threshold_k). The
sum of these tails is the expected grade, one of them decides selection.

Features of a whole text: every word (lower-cased), every word's shape (runs
of lower case, upper case, digits; other characters as they are) and whether
it repeats the word before, hashed into ``DIM`` buckets; a feature's value is
the square root of its share, so texts of any length have the same norm.

Training takes at most ``max_train_rows`` labelled rows (those with the
smallest hash of their id: a fixed uniform sample; a documented bound), whose
hashed features are counted on the executors. The fit itself (L-BFGS over
that bounded sparse matrix) runs on the driver. Scoring reads every row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ship_by_value

DIM = 1 << 14
#: Words a task remembers the features of; a work size only.
REMEMBERED = 300_000


# ---- features ----------------------------------------------------------------------

def word_shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class Features:
    """Hashed features of texts as one sparse matrix per call."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.seen: dict[str, tuple[int, int]] = {}

    def _of(self, word: str) -> tuple[int, int]:
        mask = self.dim - 1
        low = zlib.crc32(b"w" + word.lower().encode("utf-8", "surrogatepass")) & mask
        return low, zlib.crc32(b"s" + word_shape(word).encode("utf-8", "surrogatepass")) & mask

    def matrix(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value), sorted by row."""
        words = [t.split() if t else [] for t in texts]
        new = {w for ws in words for w in ws} - self.seen.keys()
        self.seen.update((w, self._of(w)) for w in new)
        look = self.seen.__getitem__
        pairs = np.array([look(w) for ws in words for w in ws], np.int64).reshape(-1, 2)
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        counts = np.array([len(ws) for ws in words], np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        again = np.zeros(len(row), bool)
        again[1:] = (pairs[1:, 0] == pairs[:-1, 0]) & (row[1:] == row[:-1])
        repeats = np.where(again, zlib.crc32(b"again") & (self.dim - 1), zlib.crc32(b"new") & (self.dim - 1))
        cell, times = np.unique(np.concatenate([row * self.dim + x for x in (pairs[:, 0], pairs[:, 1], repeats)]), return_counts=True)
        at = cell // self.dim
        return at, cell % self.dim, np.sqrt(times / counts[at])


# ---- model -------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Shared weights and increasing thresholds, one per grade above the lowest."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k + 1) for each threshold k."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, *, grades: int,
                dim: int = DIM, ridge: float = 2e-4, rounds: int = 100) -> OrdinalModel:
    """Penalised maximum likelihood by L-BFGS. ``row`` is sorted; ``grade``
    has a grade from 0 to grades - 1 per row of the matrix. Without rows, or
    with one grade only, there is nothing to learn: every tail up to that
    grade (without rows: every tail) is 1."""
    n, cuts = len(grade), grades - 1
    if not n or (grade == grade[0]).all():
        top = int(grade[0]) if n else cuts
        return OrdinalModel(np.zeros(dim), np.where(np.arange(cuts) < top, -50.0, 50.0))

    def unpack(p):
        return p[:dim], np.cumsum(np.r_[p[dim], np.exp(p[dim + 1:])])

    def loss(p):
        w, theta = unpack(p)
        score = np.bincount(row, weights=value * w[feature], minlength=n)
        tail = _sigmoid(score[:, None] - theta[None, :])
        edge = np.c_[np.ones(n), tail, np.zeros(n)]
        i = np.arange(n)
        share = np.maximum(edge[i, grade] - edge[i, grade + 1], 1e-12)
        slope = edge * (1 - edge)
        d_score = -(slope[i, grade] - slope[i, grade + 1]) / share / n
        d_theta = np.zeros(cuts)
        for k in range(cuts):
            up, here = grade == k + 1, grade == k
            d_theta[k] = ((slope[up, k + 1] / share[up]).sum() - (slope[here, k + 1] / share[here]).sum()) / n
        grad = np.zeros_like(p)
        grad[:dim] = np.bincount(feature, weights=value * d_score[row], minlength=dim) + ridge * w
        grad[dim] = d_theta.sum()
        for k in range(1, cuts):
            grad[dim + k] = d_theta[k:].sum() * np.exp(p[dim + k])
        return -np.log(share).mean() + ridge / 2 * (w @ w), grad

    above = np.array([np.clip((grade > k).mean(), 0.5 / n, 1 - 0.5 / n) for k in range(cuts)])
    start = -np.log(above / (1 - above))
    p = np.r_[np.zeros(dim), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    value_at, grad = loss(p)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(steps):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), alpha in zip(steps, reversed(alphas), strict=True):
            q += s * (alpha - rho * (y @ q))
        size, slope_along = 1.0, -(grad @ q)
        while size > 1e-8:
            new_value, new_grad = loss(p - size * q)
            if new_value <= value_at + 1e-4 * size * slope_along:
                break
            size /= 2
        else:
            break
        s, y = -size * q, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y, 1 / (s @ y))]
        gain, p, value_at, grad = value_at - new_value, p + s, new_value, new_grad
        if gain < 1e-7:
            break
    w, theta = unpack(p)
    return OrdinalModel(w, theta)


# ---- operators ---------------------------------------------------------------------

def train_quality_model(df: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, *, grades: int,
                        max_train_rows: int = 6000, dim: int = DIM) -> OrdinalModel:
    """Fits on at most ``max_train_rows`` rows of ``ratings`` (id, grade) and
    the texts of ``df`` with their ids. Rows with a null id or grade or a
    grade outside 0..grades-1 are not used, of rows with one id the smallest
    text; null texts have no features."""
    usable = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    usable = usable.where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1))
    # a bounded number of ids, so they may be broadcast: no text is shuffled to find its rating
    few = usable.withColumn("pick", F.xxhash64("id", F.lit(17))).orderBy("pick", "id", "grade").limit(max_train_rows)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    few = texts.groupBy("pick", "id", "grade").agg(F.min("text").alias("text")).select("pick", "grade", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dim)
        for batch in batches:
            row, feature, value = features.matrix(batch.column(2).to_pylist())
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(feature.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32)))], ["pick", "grade", "features", "values"])

    rows = few.mapInArrow(count, "pick long, grade int, features array<int>, values array<float>").toArrow()
    if not rows.num_rows:
        return fit_ordinal(*(np.empty(0, t) for t in (np.int64, np.int64, float, np.int64)), grades=grades, dim=dim)
    rows = rows.sort_by([("pick", "ascending"), ("grade", "ascending")]).combine_chunks()
    feature, value = rows["features"].combine_chunks(), rows["values"].combine_chunks()
    lengths = np.diff(feature.offsets.to_numpy())
    return fit_ordinal(np.repeat(np.arange(rows.num_rows), lengths), feature.flatten().to_numpy().astype(np.int64),
                       value.flatten().to_numpy().astype(float), rows["grade"].to_numpy().astype(np.int64), grades=grades, dim=dim)


def score_quality(df: DataFrame, text_col: str, model: OrdinalModel, *, column: str = "quality_score") -> DataFrame:
    """``df`` with ``column``: struct(expected_grade, tails: P(grade >= 1),
    P(grade >= 2), ...). A null or empty text has no features, so the
    thresholds alone decide. The model's size is fixed by its dimension."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade:double,tails:array<double>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        features = Features(len(model.weights))
        for texts in batches:
            row, feature, value = features.matrix(texts.to_pylist())
            tails = model.tails(np.bincount(row, weights=value * model.weights[feature], minlength=len(texts)))
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * tails.shape[1])
            yield pa.StructArray.from_arrays(
                [pa.array(tails.sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(tails.ravel()))], ["expected_grade", "tails"])

    return df.withColumn(column, score(F.col(text_col)))


def graded_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the ratings: 0 poor quality, 1 good but toxic,
    2 good; the mean of repeated ratings, rounded down. Null quality: none."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.floor(F.avg(grade)).cast("int").alias("grade")))


def classify_quality(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     min_probability: float = 0.5, max_train_rows: int = 6000, column: str = "quality_score") -> DataFrame:
    """``df`` with ``column``: struct(expected_grade, tails, keep); keep is
    P(grade >= 1) >= ``min_probability``, so texts of poor quality go. Every
    row of ``df`` comes out once, repeated ones as well. Columns of ``df``
    other than id and text are not read. No usable label: all are kept."""
    ratings = graded_labels(labels).withColumnRenamed("doc_id", id_col)
    model = train_quality_model(df, ratings, id_col, text_col, "grade", grades=3, max_train_rows=max_train_rows)
    scored = score_quality(df, text_col, model, column=column)
    return scored.withColumn(column, F.col(column).withField("keep", F.col(column)["tails"][0] >= min_probability))


ship_by_value(__name__)
