import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomstone.llm import common, token_binary, tokens

from . import helpers

PATH = tokens.public("byte_bpe_50k.json")
AWKWARD = ["", "a  b", " x", "x ", "q\n\nr", "a\tb c", "don't it's 12 345", "é x", "<|endoftext|> hi", "\n", "a\nb c", "漢字 \U0001f600 x", "~ a~b ~"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    enc = tokens.Encoder(tokens.public(name))
    texts = AWKWARD + [helpers.prose(i, 300) for i in range(20)]
    for _ in range(2):
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
        assert got == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@given(text=st.text(alphabet=" \n\tabé'~12.,<|> ́Σ", max_size=30))
def test_any_text_has_the_ids_of_the_library(name, text):
    enc = tokens.encoder(tokens.public(name))
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**13 - 1), max_size=300), st.integers(13, 20))
def test_packing_round_trip_and_random_access(ids, bits):
    a = np.array(ids, np.uint32)
    cut = len(a) // 3
    seg = token_binary.Segment(token_binary.pack(a, np.array([cut, len(a) - cut]), bits))
    assert seg.ids(0, len(a)).tolist() == ids and seg.doc(0).tolist() == ids[:cut] and seg.doc(1).tolist() == ids[cut:]


def test_random_access_over_blocks():
    a = np.random.default_rng(1).integers(0, 50257, 3 * token_binary.BLOCK_IDS + 17).astype(np.uint32)
    for bits in (16, 17):
        seg = token_binary.Segment(token_binary.pack(a, np.array([len(a)]), bits))
        for lo, hi in ((0, 1), (4095, 4097), (5000, 12000), (len(a) - 3, len(a))):
            assert seg.ids(lo, hi).tolist() == a[lo:hi].tolist()


def test_query_against_the_library(spark, tmp_path):
    helpers.awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, len(r["text"] or ""), r["text"] or "") for r in helpers.awkward(spark).collect()))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_binary.op9_token_binary(spark, str(tmp_path)).collect())
    enc, start, want = tokens.encoder(PATH), 0, []
    for there, doc, _, text in rows:
        ids = np.array([*enc.tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((start, doc if there else None, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark, tmp_path):
    s = common.Scratch(spark)
    token_binary.write_tokens(helpers.empty(spark), path := s.path("t"), PATH)
    assert token_binary.read_tokens(spark, path).count() == 0


def test_lines_of_plain_words_need_no_patterns(monkeypatch):
    enc = tokens.Encoder(PATH)
    text = "\n".join(helpers.prose(i, 40).replace(" ", ", ") + "." for i in range(30)) + "\nÉté déjà"
    want = enc.tok.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(enc, "raw", None)  # the whole library is not needed
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == want
