import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from loomstone.llm import media

from . import helpers


@given(st.binary(max_size=300))
def test_wave_round_trip(payload):
    p = media.padded(payload)
    assert len(p) % 64 == 0 and len(p) > 0 and p.startswith(payload)
    raw = media.to_wave(p)
    assert media.from_wave(raw) == (p, media.RATE)
    with wave.open(io.BytesIO(raw)) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate()) == (1, 1, media.RATE) and f.readframes(f.getnframes()) == p


def test_polyphase_equals_filter_then_drop():
    x = np.random.default_rng(0).normal(size=1000).astype(np.float32)
    fir = media._tables()[0]
    full = np.convolve(np.concatenate([np.zeros(media.TAPS - 2), x]), fir, "valid")[::2]
    # Taps are applied to windows in reading order, so the filter is reversed against a convolution; it is symmetric.
    assert np.allclose(media.halve(x), full, atol=1e-5)


def test_blocks_do_not_change_features(monkeypatch):
    payload = media.padded(np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8).tobytes())
    one = media.log_mel(payload)
    monkeypatch.setattr(media, "BLOCK", 4096)
    many = media.log_mel(payload)
    assert one[0].shape == many[0].shape and np.allclose(one[0], many[0], atol=1e-3) and np.allclose(one[1], many[1], atol=1e-5)


def test_hysteresis_by_hand():
    e = np.array([0, 1, 0.5, 0.5, 0.3, 0.5, 0.7, 0.41, 0.0])
    step = media.HOP * 2 / media.RATE
    assert media.segments(e) == [(round(1 * step, 4), round(4 * step, 4)), (round(6 * step, 4), round(8 * step, 4))]
    assert media.segments(np.ones(4)) == [(0.0, round(4 * step, 4))]


def test_tone_has_its_energy_in_its_band():
    t = np.arange(16_000) / media.RATE
    band = []
    for f in (300, 3000):
        samples = (128 + 100 * np.sin(2 * np.pi * f * t)).astype(np.uint8).tobytes()
        band.append(int(media.log_mel(samples)[0].mean(0).argmax()))
    assert band[0] < 10 < 20 < band[1]


def test_query(spark, tmp_path):
    docs = helpers.awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = media.op10_audio_features(spark, str(tmp_path)).collect()
    raw = sorted((d["doc_id"] is not None, d["doc_id"] or 0, (d["text"] or "").encode()) for d in docs.collect())
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"], r["media_bytes"]) for r in rows)
    want = sorted((there, doc, len(b), hashlib.sha256(p := media.padded(b)).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(w := media.to_wave(p)).hexdigest(), len(w)) for there, doc, b in raw)
    assert got == want
    by = {}
    for r in rows:
        assert by.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]


def test_fixed_shape_tensors_are_stored_and_read(spark, tmp_path):
    media.store(helpers.awkward(spark), "doc_id", "text", f"{tmp_path}/w")
    media.features(spark, f"{tmp_path}/w", "doc_id").write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    held = [media.read_tensors(bytes(r["arrow"])) for r in stored.collect()]
    assert sum(t.num_rows for t in held) == helpers.awkward(spark).count()
    for t in held:
        column = t.column("tensor").combine_chunks()
        assert isinstance(column.type, pa.FixedShapeTensorType) and column.to_numpy_ndarray().shape == (t.num_rows, media.BINS, media.MELS)
    good = sorted((r["doc_id"] or -1, r["feature"]) for r in media.described(stored, "doc_id").collect())
    # A tensor or span changed in the stored table is another feature.
    for wrong in ("tensor", "spans"):
        rows = []
        for t in held:
            x = t.column("tensor").combine_chunks().to_numpy_ndarray().copy()
            spans = t.column("spans").to_pylist()
            if wrong == "tensor":
                x[0, -1, -1] += 1
                t = t.set_column(t.schema.get_field_index("tensor"), "tensor", media.tensor_array(list(x)))
            else:
                spans[0] = [*spans[0], {"start": 1.0, "end": 2.0}]
                t = t.set_column(t.schema.get_field_index("spans"), "spans", pa.array(spans, media.SPANS))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as writer:
                writer.write_table(t)
            rows.append((bytearray(sink.getvalue().to_pybytes()),))
        bad = media.described(spark.createDataFrame(rows, "arrow binary"), "doc_id").collect()
        assert sorted((r["doc_id"] or -1, r["feature"]) for r in bad) != good
    media.store(helpers.empty(spark), "doc_id", "text", f"{tmp_path}/e")
    assert media.described(media.features(spark, f"{tmp_path}/e", "doc_id"), "doc_id").count() == 0


def plain_feature(payload):
    """The feature by its definition: one sum per sample, frame, frequency and band."""
    x = [(v - 128) / 128 for v in payload]
    fir, bank, hann = (t.astype(float).tolist() for t in media._tables())
    line = [0.0] * (media.TAPS - 2) + x + [0.0] * (len(x) & 1)
    half = [sum(line[k + t] * fir[t] for t in range(media.TAPS)) for k in range(0, len(line) - media.TAPS + 1, 2)]
    frames, k = [], 0
    while not frames or (k - 1) * media.HOP + media.WINDOW < len(half):
        frames.append([*half[k * media.HOP : k * media.HOP + media.WINDOW], *[0.0] * media.WINDOW][: media.WINDOW])
        k += 1
    angle = -2j * np.pi / media.WINDOW
    mels, energy = [], []
    for f in frames:
        power = [abs(sum(f[t] * hann[t] * np.exp(angle * q * t) for t in range(media.WINDOW))) ** 2 for q in range(media.WINDOW // 2 + 1)]
        mels.append([np.log(sum(power[q] * bank[q][m] for q in range(len(power))) + 1e-6) for m in range(media.MELS)])
        energy.append(sum(v * v for v in f) / media.WINDOW)
    low, span = min(energy), max(energy) - min(energy)
    on, state = [], False
    for e in energy:
        state = True if e >= low + media.HIGH * span else False if e < low + media.LOW * span else state
        on.append(state)
    pool = []
    for b in range(media.BINS):
        lo = min(int(b * len(frames) / media.BINS), len(frames) - 1)
        hi = max(int(np.ceil((b + 1) * len(frames) / media.BINS)), lo + 1)
        pool.append([sum(m[j] for m in mels[lo:hi]) / (hi - lo) for j in range(media.MELS)])
    return len(frames), on, np.array(pool)


def test_query_against_the_definition(spark, tmp_path):
    texts = [helpers.prose(1, 40), "aaaa" * 90 + "\x7f\x01" * 200 + "aaaa" * 90, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in media.op10_audio_features(spark, str(tmp_path)).collect():
        n, on, pool = plain_feature(media.padded(texts[r["doc_id"]].encode()))
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert int(said["frames"]) == n and np.allclose([float(v) for v in said["mel"].split(",")], pool.reshape(-1), atol=0.11)
        step = media.HOP * 2 / media.RATE
        if n > 1:
            assert int(said["segments"]) == sum(b and not a for a, b in zip([False, *on], on, strict=False))
            assert abs(float(said["voiced"]) - step * sum(on)) < 1e-3


def test_feature_tells_recordings_apart_after_the_first_eighth(spark, tmp_path):
    head = helpers.prose(1, 1500)
    rows = [(k, f"{head} {tail}") for k, tail in enumerate(("ka lo " * 3000, "zz yy " * 3000))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    mels = [dict(x.split("=") for x in r["feature"].split(";"))["mel"] for r in media.op10_audio_features(spark, str(tmp_path)).collect()]
    assert len({*mels}) == 2 and all(len(x.split(",")) == media.BINS * media.MELS for x in mels)


def test_rows_of_the_stored_table_hold_few_recordings(spark, tmp_path):
    n = 3 * media.ROWS + 5
    media.store(spark.createDataFrame([(i, f"text {i}") for i in range(n)], "doc_id bigint, text string").coalesce(1), "doc_id", "text", f"{tmp_path}/w")
    held = [media.read_tensors(bytes(r["arrow"])) for r in media.features(spark, f"{tmp_path}/w", "doc_id").collect()]
    assert max(t.num_rows for t in held) <= media.ROWS and sorted(x for t in held for x in t.column("doc_id").to_pylist()) == list(range(n))
