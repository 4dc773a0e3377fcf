import random

import pyarrow as pa
import pytest

from loomstone.llm import common, tokens

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_words_give_the_ids_of_the_library(name):
    enc, r = tokens.Encoder(tokens.public(name)), random.Random(3)
    assert enc.plain
    letters = [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *(chr(c) for c in range(0xC0, 0x100))]  # × and ÷ among them
    odd = [*"0123456789'_\"#-.,;:!?()[]{}<>|~^`@/\\", "'s", "'LL", "́", "İ", "Σ", "ª", "µ", "中", "​", " ", "\t", "<|endoftext|>"]
    made = ["".join(r.choices(letters, k=r.randint(1, 40))) + "".join(r.choices(odd, k=r.choice([0, 0, 1, 2]))) for _ in range(3000)]
    made += ["".join(r.choices([*letters, *odd], k=r.randint(1, 12))) for _ in range(3000)]
    texts = ["".join(w + r.choice([" ", " ", " ", "\n", "  ", "\n\n", " \n"]) for w in r.choices(made, k=r.randint(0, 60))) for _ in range(300)]
    texts += [" ".join(r.choices(made, k=50)) for _ in range(200)] + ["\n".join(r.choices(made, k=50)) for _ in range(100)] + ["", " ", "\n", "a", "\na", "a\n", "Été,\nÀ la"]
    for some in (texts, texts[::-1]):
        assert enc.encode(some) == enc.raw(some)


@pytest.mark.parametrize("name", NAMES)
def test_plain_words_go_to_the_merges_and_memory_is_bounded_within_a_batch(name, monkeypatch):
    enc, r = tokens.Encoder(tokens.public(name)), random.Random(4)
    text = " ".join(["".join(r.choices("abcdéÉ", k=8)) + r.choice(["", ",", "...", "!)"]) for _ in range(4000)])
    want = enc.raw([text])
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    monkeypatch.setattr(enc, "raw", None)  # the whole library is not needed
    assert enc.encode([text]) == want and len(enc.known) <= 100 and len(enc.known.old) <= 100


def test_other_vocabularies_go_through_the_whole_library(tmp_path):
    from tokenizers import Tokenizer, normalizers

    tok = Tokenizer.from_file(tokens.public("word_bpe_49k.json"))
    tok.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    tok.save(str(tmp_path / "other.json"))
    enc, text = tokens.Encoder(str(tmp_path / "other.json")), "Été déjà, vu"
    assert not enc.plain and enc.encode([text]) == enc.raw([text])


def test_a_worker_forgets_the_words_of_an_earlier_stage(monkeypatch):
    stage, batch = [7], pa.record_batch({"text": ["a", "b"]})
    monkeypatch.setattr(tokens, "_stage", lambda: stage[0])
    enc = tokens.encoder(tokens.public(NAMES[0]))
    assert len(list(common.slices(iter([batch]), "text"))) == 1
    assert tokens.encoder(tokens.public(NAMES[0])) is enc  # the stage's next task
    stage[0] = 8
    list(common.slices(iter([batch]), "text"))
    assert tokens.encoder(tokens.public(NAMES[0])) is not enc
    tokens._used[0] = None
