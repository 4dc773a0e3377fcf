"""Binary vector files: number and dimension (unsigned 32-bit), then the components (32-bit floats), little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 10_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) with unit vectors, ids from 0 in file order; a truncated file or zero sizes raise ValueError."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                n, dim = struct.unpack_from("<II", raw) if len(raw) >= 8 else (0, 0)
                if not n or not dim or len(raw) < 8 + 4 * n * dim:
                    raise ValueError("truncated file or zero sizes")
                x = np.frombuffer(raw, "<f4", n * dim, 8).reshape(n, dim)
                for k in range(0, n, ROWS):
                    v = x[k : k + ROWS].astype(np.float64)
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    v = (v / np.where(size > 0, size, 1)).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
                    yield pa.record_batch([pa.array(np.arange(k, k + len(v), dtype=np.int64)), lists], names=["id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "id bigint, embedding array<float>")


def to_bytes(vectors: np.ndarray) -> bytes:
    x = np.ascontiguousarray(vectors, "<f4")
    return struct.pack("<II", *x.shape) + x.tobytes()
