import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from loomstone.llm import words

from . import helpers


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09 é,\n漢-_", max_size=40)), max_size=8))
def test_scan_finds_the_words_of_the_pattern(texts):
    w = words.scan(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for d, a, b in zip(w.doc, w.start, w.end, strict=True):
        got[d].append(texts[d].encode()[a:b].decode().translate(helpers.LOWER))
    assert got == [helpers.words(t) for t in texts]
    flat = [x for g in got for x in g]
    assert list(w.hash) == list(words.hash_words(flat))
    assert len(set(w.hash.tolist())) == len(set(flat))


def test_blocks_do_not_change_hashes(monkeypatch):
    text = helpers.prose(9, 3000)
    whole = words.scan(pa.array([text, "x", text]))
    monkeypatch.setattr(words, "BLOCK", 50)
    assert (words.scan(pa.array([text, "x", text])).hash == whole.hash).all()
