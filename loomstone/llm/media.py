"""Media columns: 8-bit audio with polyphase resampling, log-mel filterbanks and energy segments.

``store`` keeps each payload losslessly as a RIFF/WAVE file of unsigned 8-bit mono samples in a Parquet table;
``features`` reads the stored bytes back and computes, per recording,

* the signal at half the rate, by a polyphase low-pass filter (both phases of the FIR over the even and odd samples);
* log energies of MELS mel bands over Hann windows of WINDOW samples every HOP samples (overlapping by half or more);
* segments by hysteresis: one opens where the frame energy reaches the high threshold and closes where it falls under
  the low one, both set between the recording's lowest and highest frame energy;
* one tensor of fixed shape (BINS, MELS): the frames averaged over BINS equal spans of time.

The results are stored as Arrow record batches with a column of fixed-shape tensors beside ``spans``, the start and end
seconds of each segment, and are read back from there. A recording is computed by itself and in blocks of BLOCK samples,
so equal payloads give equal values and a very long one takes no more memory than its energies. A payload is one value
of a row, so it has less than 2 GB, which the 32-bit sizes of the file format hold.

Nulls: a null payload is empty, a null id stays null; empty payloads are padded to PAD bytes like any other. Repeated
rows are kept. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE, PAD = 16_000, 64
TAPS, WINDOW, HOP, MELS, BINS = 32, 200, 100, 32, 8
BLOCK = 1 << 18
#: Most recordings of one stored record batch, which is one row of the table.
ROWS = 64
HIGH, LOW = 0.6, 0.4
WAVE = struct.Struct("<4sI4s4sIHHIIHH4sI")


def padded(payload: bytes) -> bytes:
    """With bytes 0 appended up to a positive multiple of PAD."""
    return payload + bytes(-len(payload) % PAD or (0 if payload else PAD))


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE, PCM, one channel, 8 bits unsigned."""
    odd = len(samples) & 1
    return WAVE.pack(b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + bytes(odd)


def from_wave(raw: bytes) -> tuple[bytes, int]:
    riff, _, wave, _, _, kind, channels, rate, _, _, bits, _, n = WAVE.unpack_from(raw)
    if (riff, wave, kind, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8):
        raise ValueError("not 8-bit mono PCM")
    return raw[WAVE.size : WAVE.size + n], rate


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = np.arange(TAPS) - (TAPS - 1) / 2
    fir = np.sinc(t / 2) / 2 * np.hamming(TAPS)
    fir = (fir / fir.sum()).astype(np.float32)
    n = WINDOW // 2 + 1
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 4), MELS + 2) / 2595) - 1)
    f = np.linspace(0, RATE / 4, n)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
    bank[bank.sum(1) == 0, 0] = 1e-9
    return fir, bank.T.astype(np.float32), np.hanning(WINDOW).astype(np.float32)


def halve(x: np.ndarray) -> np.ndarray:
    """Every second sample of the low-passed signal: the even taps meet the even samples, the odd taps the odd ones."""
    fir = _tables()[0]
    y = np.concatenate([np.zeros(TAPS - 2, np.float32), x, np.zeros(len(x) & 1, np.float32)])
    n = (len(y) - TAPS) // 2 + 1
    return np.correlate(y[0::2], fir[0::2], "valid")[:n] + np.correlate(y[1::2], fir[1::2], "valid")[:n]


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, energy of each frame), block by block."""
    _, bank, hann = _tables()
    raw = np.frombuffer(samples, np.uint8)
    mels, energy, rest = [], [], np.zeros(0, np.float32)
    for at in range(0, len(raw), BLOCK):
        lead = min(at, TAPS - 2)
        x = (raw[at - lead : at + BLOCK].astype(np.float32) - 128) / 128
        y = np.concatenate([rest, halve(x)[lead // 2 :]])
        n = max(0, (len(y) - WINDOW) // HOP + 1)
        if at + BLOCK >= len(raw) and (not n or len(y) > WINDOW + (n - 1) * HOP):
            y = np.concatenate([y, np.zeros(WINDOW + n * HOP - len(y), np.float32)])
            n += 1
        for k in range(0, n, 1024):
            m = min(1024, n - k)
            frames = np.lib.stride_tricks.sliding_window_view(y[k * HOP : (k + m - 1) * HOP + WINDOW], WINDOW)[::HOP]
            power = np.abs(np.fft.rfft(frames * hann)).astype(np.float32) ** 2
            mels.append(np.log(power @ bank + np.float32(1e-6)))
            energy.append(np.einsum("ij,ij->i", frames, frames) / WINDOW)
        rest = y[n * HOP :]
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """(start, end) seconds of each stretch of high energy."""
    low, span = float(energy.min()), float(np.ptp(energy))
    if span <= 1e-9:
        return [(0.0, round(len(energy) * HOP * 2 / RATE, 4))]
    # A frame above the high threshold turns the state on, one below the low threshold off; the others keep it.
    turn = np.where(energy >= low + HIGH * span, 1, np.where(energy < low + LOW * span, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), 0))
    on = np.concatenate([[False], turn[last] == 1, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    step = HOP * 2 / RATE
    return [(round(a * step, 4), round(b * step, 4)) for a, b in edge.reshape(-1, 2).tolist()]


def pooled(mels: np.ndarray) -> np.ndarray:
    """The mean of the frames over BINS equal spans of time."""
    at = np.linspace(0, len(mels), BINS + 1)
    lo = np.minimum(at[:-1].astype(int), len(mels) - 1)
    hi = np.maximum(np.ceil(at[1:]).astype(int), lo + 1)
    total = np.concatenate([np.zeros((1, mels.shape[1])), np.cumsum(mels, 0, dtype=np.float64)])
    return ((total[hi] - total[lo]) / (hi - lo)[:, None]).astype(np.float32)


def store(rows: DataFrame, key: str, payload: str, path: str) -> None:
    """``rows(key, payload)`` as a table of WAVE files: key, n_bytes, wave."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([to_wave(padded(x)) for x in raw], pa.binary())], names=[key, "n_bytes", "wave"])

    rows = rows.select(F.col(key).cast("bigint").alias(key), F.col(payload).cast("binary").alias(payload))
    rows.mapInArrow(write, f"{key} bigint, n_bytes bigint, wave binary").write.option("compression", "zstd").parquet(path)


TENSOR = pa.fixed_shape_tensor(pa.float32(), [BINS, MELS], dim_names=["time", "mel"])
SPANS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "frames": pa.int64()}


def tensor_array(tensors: list[np.ndarray]) -> pa.ExtensionArray:
    """Arrays of shape (BINS, MELS) as an Arrow array of fixed-shape tensors."""
    flat = pa.array(np.concatenate([np.zeros(0, np.float32), *(x.reshape(-1) for x in tensors)]), pa.float32())
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, BINS * MELS))


def features(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What the stored files hold, as Arrow record batches (one a row of ``arrow``) with a column of fixed-shape tensors.

    A batch has the key, digests of the payload and of the file, the number of frames, ``tensor`` and ``spans``.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(k, ROWS) for x in common.slices(batches, "wave", 4 << 20) for k in range(0, x.num_rows, ROWS)):
            out: list[list] = [[] for _ in range(8)]
            for raw in batch.column("wave").to_pylist():
                samples, _ = from_wave(raw)
                mels, energy = log_mel(samples)
                for column, x in zip(out, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(raw), hashlib.sha256(raw).hexdigest(), len(energy), pooled(mels), [{"start": a, "end": b} for a, b in segments(energy)]), strict=True):
                    column.append(x)
            plain = [batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(out, list(FIELDS.values())[1:], strict=False))]
            rows = pa.record_batch([batch.column(key), *plain, tensor_array(out[-2]), pa.array(out[-1], SPANS)], names=[key, *FIELDS, "tensor", "spans"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_batch(rows)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["arrow"])

    stored = spark.read.schema(f"{key} bigint, n_bytes bigint, wave binary").parquet(path)
    return stored.mapInArrow(compute, "arrow binary")


def read_tensors(raw: bytes) -> pa.Table:
    """The record batch of one row of ``features``, with its tensor column typed."""
    table = pa.ipc.open_stream(raw).read_all()
    if table.schema.field("tensor").type != TENSOR:
        raise ValueError(f"tensors of type {table.schema.field('tensor').type}")
    return table


def described(tables: DataFrame, key: str) -> DataFrame:
    """One row per recording of the stored ``tables(arrow)``: key, digests and ``feature``, all tensor values and spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("arrow").to_pylist():
                table = read_tensors(raw)
                tensors = table.column("tensor").combine_chunks().to_numpy_ndarray()
                text = []
                for x, frames, spans in zip(tensors, table.column("frames").to_pylist(), table.column("spans").to_pylist(), strict=True):
                    voiced = round(sum(s["end"] - s["start"] for s in spans), 3)
                    mel = ",".join([f"{v:.1f}" for v in x.reshape(-1).tolist()])
                    text.append(f"frames={frames};segments={len(spans)};voiced={voiced};mel={mel};spans={','.join(f'{s['start']}-{s['end']}' for s in spans)}")
                columns = [c for c in (key, *FIELDS) if c != "frames"]
                for part in table.select(columns).append_column("feature", pa.array(text, pa.string())).to_batches():
                    yield part

    names = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in FIELDS.items() if n != "frames")
    return tables.mapInArrow(run, f"{key} bigint, {names}, feature string")


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = common.Scratch(spark)
    store(common.read(spark, sf_dir, "documents"), "doc_id", "text", path := s.path("waves"))
    tables = s.table(features(spark, path, "doc_id"), "tensors")
    return s.result(described(tables, "doc_id"), "audio")
