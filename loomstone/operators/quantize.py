"""Vector codes: products of small codebooks, rotated scalar codes with a sign residual, sign and tier bits.

Codebooks are fitted on a bounded sample (a parameter); every vector is encoded and scored by numpy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return v.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def sampled(vectors: DataFrame, rows: int) -> np.ndarray:
    return unit(np.array([np.asarray(v, float) for v in vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("embedding").toPandas()["embedding"]]))


class Product(NamedTuple):
    """Codebooks (parts, codes, dimensions of a part)."""

    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, parts: int = 8, codes: int = 16, steps: int = 15, seed: int = 1) -> Product:
        r, books = np.random.default_rng(seed), []
        for p in np.split(x, parts, axis=1):
            c = p[r.permutation(len(p))[:codes]]
            for _ in range(steps):
                own = ((p[:, None] - c) ** 2).sum(2).argmin(1)
                c = np.array([p[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
            books.append(c)
        return cls(np.array(books))

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.split(x, len(self.books), axis=1)
        return np.stack([((p[:, None] - c) ** 2).sum(2).argmin(1) for p, c in zip(parts, self.books, strict=True)], 1).astype(np.uint8)

    def decoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coded vectors and the lengths of their residuals."""
        y = self.books[np.arange(len(self.books)), self.encode(x)].reshape(len(x), -1)
        return y, np.linalg.norm(x - y, axis=1)

    def scores(self, codes: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products of a query with the coded vectors, by one table look-up a part."""
        table = np.einsum("pcd,pd->pc", self.books, query.reshape(len(self.books), -1))
        return table[np.arange(len(self.books)), codes].sum(1)


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(len(h))


class Rotated(NamedTuple):
    """Random signs and a Hadamard rotation, then scalar levels (Lloyd-Max on the sample) and the residual's signs."""

    signs: np.ndarray
    levels: np.ndarray
    project: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, bits: int = 2, seed: int = 1) -> Rotated:
        r, d = np.random.default_rng(seed), 1 << (x.shape[1] - 1).bit_length()
        made = cls(r.choice([-1.0, 1.0], d), np.zeros(1 << bits), r.normal(size=(d, d)))
        flat = np.sort(made.rotate(x).ravel())
        levels = np.quantile(flat, (np.arange(1 << bits) + 0.5) / (1 << bits))
        for _ in range(30):
            own = np.searchsorted((levels[1:] + levels[:-1]) / 2, flat)
            levels = np.array([flat[own == j].mean() if (own == j).any() else levels[j] for j in range(len(levels))])
        return made._replace(levels=levels)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, len(self.signs) - x.shape[1])))
        return (x * self.signs) @ hadamard(len(self.signs))

    def decoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coded vectors, rotated back, and the lengths of their residuals."""
        y = self.rotate(x)
        coded = self.levels[np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, y)]
        return ((coded @ hadamard(len(self.signs))) * self.signs)[:, : x.shape[1]], np.linalg.norm(y - coded, axis=1)

    def scores(self, x: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Estimated inner products: the levels' part, and the residual's by its projected signs and length."""
        y, q = self.rotate(x), self.rotate(query[None])[0]
        coded = self.levels[np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, y)]
        rest = y - coded
        z = np.sign(rest @ self.project.T)
        return coded @ q + np.sqrt(np.pi / 2) / len(q) * np.linalg.norm(rest, axis=1) * (z @ (self.project @ q))


def tiers(x: np.ndarray, high: float = 64 / 127, low: float = 32 / 127) -> np.ndarray:
    """Sign times 2 for large, 1 for middle, 0 for small components."""
    return np.sign(x) * np.where(np.abs(x) >= high, 2, np.where(np.abs(x) >= low, 1, 0))


def coded_topk(vectors: DataFrame, query: Sequence[float], k: int, codec: Product | Rotated, rerank: int = 4) -> DataFrame:
    """The best ``rerank`` x k by codes, ranked again by exact distance."""
    from . import vector

    q = unit(np.asarray(query, float))
    held = vectors.sparkSession.sparkContext.broadcast((codec, q))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, q = held.value
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("embedding")))
                s = codec.scores(codec.encode(x), q) if isinstance(codec, Product) else codec.scores(x, q)
                yield pa.record_batch([batch.column("id"), pa.array(s)], names=["id", "score"])

    best = vectors.select(F.col("id").cast("bigint").alias("id"), "embedding").mapInArrow(score, "id bigint, score double").orderBy(F.desc("score"), "id").limit(rerank * k)
    return vector.topk(vectors.join(best.select("id"), "id"), query, k)


def coded_batch(vectors: DataFrame, queries: DataFrame, k: int, codec: Product | Rotated) -> DataFrame:
    """The k nearest of each of ``queries(qid, embedding)``: qid, id, dist, rank (from 1), as by exact search.

    Codes skip only what cannot be among them: an inner product differs from that of the coded vector by the length of
    the residual at most. The rest is ranked by exact distance where it is read.
    """
    from . import vector

    def keep(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        coded, rest = codec.decoded(x)
        est, slack = q @ coded.T, rest + 1e-9
        low = est - slack
        floor = np.partition(low, -k, axis=1)[:, -k][:, None] if len(x) > k else np.full((len(q), 1), -np.inf)
        return est + slack >= floor

    return vector.batch_topk(vectors, queries, k, keep=keep)
