"""Token-ID output: fixed-width bit packing with block offsets.

``write_tokens`` encodes texts, orders them by id, and writes packed segments; ``read_tokens`` gives the ids back.

A segment is the bytes of one file: a header (magic, bits per id, ids per block, number of ids, number of documents),
the documents' first positions (unsigned 64-bit, one end more), the byte offset of each block (unsigned 64-bit), then
the blocks. An id takes the fewest bits that hold every id of the vocabulary, most significant bit first; a block of
BLOCK_IDS ids is padded to a whole byte, so any id is found with one offset and one shift, and a block is unpacked by
numpy without a loop. Segments of about SEGMENT_IDS ids are rows of a Parquet table, written through Spark's committer:
a lost executor leaves no half file, and the table can lie in any store that Spark writes to.

Nulls: a null text is empty (its only id is the end id); rows with a null doc_id come first. Rows that repeat a doc_id
are kept, ordered by the text's length. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"LSPK"
HEADER = struct.Struct("<4sHHIQQ")
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :].reshape(-1)).tobytes()


def unpack_block(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, ">u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def pack(ids: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    """One segment holding the documents of these lengths, their ids end to end."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    blocks = [pack_block(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    at = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    where = np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype("<u8")[: len(blocks)]
    return b"".join([HEADER.pack(MAGIC, bits, 0, BLOCK_IDS, len(ids), len(lengths)), at.tobytes(), where.tobytes(), *blocks])


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, raw: bytes):
        magic, self.bits, _, self.block, self.n_ids, self.n_docs = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a packed segment")
        self.raw, k = raw, HEADER.size
        self.docs = np.frombuffer(raw, "<u8", self.n_docs + 1, k).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.where = np.frombuffer(raw, "<u8", n_blocks, k + 8 * (self.n_docs + 1)).astype(np.int64)
        self.first = k + 8 * (self.n_docs + 1) + 8 * n_blocks

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``, reading only the blocks that hold them."""
        if not 0 <= start <= end <= self.n_ids:
            raise IndexError((start, end))
        out = []
        for b in range(start // self.block, -(-end // self.block)):
            n = min(self.block, self.n_ids - b * self.block)
            lo = self.first + int(self.where[b])
            out.append(unpack_block(self.raw[lo : lo + -(-n * self.bits // 8)], n, self.bits))
        skip = start // self.block * self.block
        return np.concatenate(out)[start - skip : end - skip] if out else np.zeros(0, np.uint32)

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.docs[k]), int(self.docs[k + 1]))


SEGMENTS = "shard int, segment int, doc_ids array<bigint>, n_ids bigint, packed binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, bits: int | None = None, partitions: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order and write the packed segments to ``path``.

    The order comes from a range partitioning of the texts, so each task holds one range and one segment at a time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, k = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = bits or bits_for(enc.tok.get_vocab_size())
        ids, docs_in, lengths, total = [], [], [], 0

        def segment() -> pa.RecordBatch:
            raw = pack(np.frombuffer(b"".join(ids), enc.dtype), np.array(lengths, np.int64), width)
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([docs_in], pa.list_(pa.int64())), pa.array([total], pa.int64()), pa.array([raw], pa.binary())], names=["shard", "segment", "doc_ids", "n_ids", "packed"])

        for batch in common.slices(batches, "text", 4 << 20):
            for doc, x in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                ids.append(x + enc.end)
                n = len(ids[-1]) // enc.dtype.itemsize
                docs_in.append(doc)
                lengths.append(n)
                total += n
                if total >= SEGMENT_IDS:
                    yield segment()
                    ids, docs_in, lengths, total, k = [], [], [], 0, k + 1
        if docs_in:
            yield segment()

    rows = common.filled(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.length("text"))
    rows.mapInArrow(encode, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, n_tokens, ids_crc32, and ``start``, the ids before it in the whole order."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["packed"])
                ids = seg.ids(0, seg.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(seg.docs[:-1], seg.docs[1:], strict=True)]
                n = seg.n_docs
                yield pa.record_batch([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(seg.docs[:-1], pa.int64()), pa.array(np.diff(seg.docs), pa.int64()), pa.array(crc, pa.int64())], names=["shard", "segment", "doc_id", "within", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("shard", "segment").agg(F.sum("n_ids").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    # The rows that meet in one place are one for each partition of the files.
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier.orderBy("shard")), F.lit(0)).alias("base"))
    segments = totals.select("shard", "segment", F.coalesce(F.sum("n").over(earlier.partitionBy("shard").orderBy("segment")), F.lit(0)).alias("before"))
    totals = segments.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("before")).alias("before"))
    rows = files.mapInArrow(unpack, "shard int, segment int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(totals, ["shard", "segment"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = common.Scratch(spark)
    write_tokens(common.read(spark, sf_dir, "documents"), path := s.path("tokens"), tokens.public("byte_bpe_50k.json"))
    return s.result(read_tokens(spark, path), "token-rows")
