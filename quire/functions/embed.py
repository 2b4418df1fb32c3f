"""Embedding step: text -> float vector, run inside Spark tasks.

The embedder is any picklable callable ``list[str] -> np.ndarray (n, dim)``.
The default is a deterministic feature-hashing embedder (no network, no
model files). Work is chunked inside each Arrow batch; a failing chunk is halved
until the texts that fail stand alone: those get zero vectors with status
``failed``, the others theirs, and the job goes on. Rows are keyed by id, so vectors can never shift to another document.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions._ship import ship_by_value
from quire.session import checked_broadcast, path_exists

ship_by_value(__name__)

# Texts of one call, and the length that a model of the remote kind takes.
CHUNK_SIZE = 20
MODEL_CHARS = 32_000
#: Tokens whose place a task remembers; a work size only.
REMEMBERED_TOKENS = 100_000

_TOKEN = re.compile(r"[^\W]+(?:['’.][^\W]+)*", re.UNICODE)


class _Places(dict):
    """Place of a token: that of its hash, ``dim`` further if its sign is minus."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        h = zlib.crc32(token.encode("utf-8"))
        self[token] = place = h % self.dim + (0 if (h >> 31) & 1 else self.dim)
        return place

    def __reduce__(self):
        return _Places, (self.dim,)


class HashingEmbedder:
    """Signed feature hashing of lower-cased tokens, L2-normalised."""

    def __init__(self, dim: int = 768):
        self.dim, self.places = dim, _Places(dim)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            if len(self.places) > REMEMBERED_TOKENS:
                self.places.clear()
            at = np.fromiter(map(self.places.__getitem__, _TOKEN.findall(t.lower())), np.int64)
            signed = np.bincount(at, minlength=2 * self.dim)
            out[i] = signed[:self.dim] - signed[self.dim:]
            n = np.linalg.norm(out[i])
            if n > 0:
                out[i] /= n
        return out


class PiecewiseEmbedder:
    """For models that take ``max_chars`` at most: a longer text is embedded
    in pieces and gets the mean of their vectors, of length 1."""

    def __init__(self, inner: Callable, max_chars: int = MODEL_CHARS):
        self.inner, self.max_chars = inner, max_chars

    def __call__(self, texts: list[str]) -> np.ndarray:
        pieces = [[t[a:a + self.max_chars] for a in range(0, max(1, len(t)), self.max_chars)] for t in texts]
        vectors = np.asarray(self.inner([p for ps in pieces for p in ps]), dtype=np.float32)
        ends = np.cumsum([len(ps) for ps in pieces])
        out = np.stack([part.mean(axis=0) if len(part) > 1 else part[0] for part in np.split(vectors, ends[:-1])])
        for i, ps in enumerate(pieces):
            if len(ps) > 1 and (n := np.linalg.norm(out[i])) > 0:
                out[i] /= n
        return out


def _embed_texts(embedder: Callable, dim: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = series.fillna("").astype(str).tolist()
            vectors = np.zeros((len(texts), dim), dtype=np.float32)
            status = np.array(["ok" if t.strip() else "blank" for t in texts], dtype=object)
            todo = np.flatnonzero(status == "ok")
            for at in range(0, len(todo), CHUNK_SIZE):
                parts = [todo[at:at + CHUNK_SIZE]]
                while parts:
                    rows = parts.pop()
                    try:
                        got = np.asarray(embedder([texts[i] for i in rows]), dtype=np.float32)
                        if got.shape != (len(rows), dim):
                            raise ValueError(f"embedder returned {got.shape}")
                        vectors[rows] = got
                    except Exception:
                        if len(rows) == 1:
                            status[rows] = "failed"  # a zero vector for this text only
                        else:
                            parts += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
            yield pd.DataFrame({"vector": list(vectors), "status": status})
    return run


def embed_column(df: DataFrame, text_col: str, dim: int = 768, embedder: Callable | None = None, *,
                 column: str = "embedding", status: str = "embed_status") -> DataFrame:
    """``df`` with the vector (array<float>) and status of every row's whole
    text. The embedder takes texts of any length (see PiecewiseEmbedder)."""
    schema = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("status", T.StringType())])
    udf = F.pandas_udf(_typed(_embed_texts(embedder or HashingEmbedder(dim), dim)), schema)
    out = df.withColumn("_embedded", udf(F.col(text_col)))
    return out.withColumn(column, F.col("_embedded.vector")).withColumn(status, F.col("_embedded.status")).drop("_embedded")


class EmbeddingStore:
    """Vectors by the digest of their text, in folders of one batch each; a text
    that any earlier batch had is not embedded again."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 768, embedder: Callable | None = None):
        self.spark, self.path, self.dim, self.embedder = spark, path.rstrip("/"), dim, embedder

    def known(self) -> DataFrame:
        if not path_exists(self.spark, self.path):  # nothing stored yet
            return self.spark.createDataFrame([], "digest binary, vector array<float>, status string")
        return self.spark.read.parquet(f"{self.path}/batch=*").select("digest", "vector", "status")

    def embed(self, df: DataFrame, text_col: str, *, column: str = "embedding", status: str = "embed_status") -> tuple[DataFrame, int]:
        """``df`` with vector and status of every row's whole text (null:
        empty), and how many texts had to be embedded for it: distinct ones
        that are not stored, and those that failed before. Rows are known by
        their digests, so only texts that are to be embedded move. ``df`` is
        read several times: cut its lineage if it may differ between reads."""
        keyed = df.withColumn("_digest", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
        done = self.known().where("status <> 'failed'").select(F.col("digest").alias("_digest"))
        new = checked_broadcast(keyed.select("_digest").distinct().join(done, "_digest", "left_anti"), name="new_digests")
        n = new.count()
        if n:
            texts = keyed.select("_digest", text_col).join(new, "_digest", "left_semi").groupBy("_digest").agg(F.first(F.col(text_col)).alias("text"))
            found = embed_column(texts, "text", self.dim, self.embedder, column="vector", status="status")
            found.select(F.col("_digest").alias("digest"), "vector", "status").write.parquet(f"{self.path}/batch={uuid.uuid4().hex}")
        # of a text that failed once and went well later the vector that went well
        best = self.known().groupBy(F.col("digest").alias("_digest")).agg(
            F.max_by(F.struct("vector", "status"), F.col("status") != "failed").alias("_best"))
        out = keyed.join(best, "_digest", "left").withColumn(column, F.col("_best.vector")).withColumn(status, F.col("_best.status"))
        return out.drop("_digest", "_best"), n


def _typed(run):
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return embed
