"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker while it is remembered.

Both public vocabularies split a text at white space before any merge, so a text may be cut in front of a single space
between two other characters and its parts encoded apart: the ids are those of the whole text. Texts where such a cut
is not safe (runs of white space, white space at an end of a part) go through the library in one piece.

A word of ASCII and Latin-1 letters with ASCII marks behind it goes to the library's merges at once: what its normalizer
and its splitting by patterns make of such a word is known (the letters, then the marks), and they take most of its time.
All other words, and all words of a vocabulary with another normalizer or other patterns, go through the whole library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
from pyspark import TaskContext

END_ID = 2
#: Words that a worker remembers in each of two generations, about 160 bytes each. When the young one is full it becomes
#: the old one, and what was in the old one and has not been met since is forgotten. Longer words seldom come twice.
REMEMBERED, WORD_CHARS = 250_000, 30
#: Letters, then marks without the apostrophe, which may begin a contraction.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: The normalizers and patterns for which PLAIN holds.
KNOWN = (
    (None, _BYTES),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {**_BYTES, "use_regex": False}]},
    ),
)


def _shown() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in itself else chr(next(others)) for b in range(256)]


def _letters(lower: bool) -> dict[int, str]:
    """What becomes of Latin-1 letters, for ``str.translate``."""
    shown = _shown()
    return {c: "".join(shown[b] for b in (chr(c).lower() if lower else chr(c)).encode()) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100))}


class Remembered(dict):
    """Ids by word; ``fresh`` makes those of a word not met yet or forgotten."""

    def __init__(self, fresh):
        super().__init__()
        self.fresh, self.old = fresh, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.fresh(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """``encode(texts)``: for each text its ids as little-endian unsigned 16-bit (32-bit for larger vocabularies) bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, size = self.tok.model, self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.drops_space = self.tok.normalizer is not None
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.plain = (made["normalizer"], made["pre_tokenizer"]) in KNOWN and all(x["special"] for x in made["added_tokens"])
        self.letters, self.marks = _letters(lower=self.drops_space), {}
        self.bytes_of = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.known = Remembered(self.word)
        self.end = np.array([END_ID], self.dtype).tobytes()

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, piece: str) -> bytes:
        """The ids of what the patterns leave in one piece."""
        ids = self.bytes_of
        return b"".join([ids[x.id] for x in self.model.tokenize(piece)])

    def word(self, key: str) -> bytes:
        """The ids of a word with a space before it, where the vocabulary does not drop it; a line feed stands for itself, two for nothing."""
        lines = 0 if self.drops_space else len(key) - len(key.lstrip("\n"))
        found = PLAIN(key, lines) if self.plain else None
        if found is None:
            return self.raw([key if self.drops_space else key[2:] if lines == 2 else key if lines else f" {key}"])[0]
        letters, marks = found.groups()
        if marks and not lines:
            ids = self.known[letters]
        else:
            shown = letters.translate(self.letters) if not letters.isascii() or self.drops_space else letters
            ids = self.merged(shown if self.drops_space or lines else f"\u0120{shown}")
            if lines == 1:
                ids = self.merged("\u010a") + ids
        if not marks:
            return ids
        after = self.marks.get(marks)
        if after is None:
            after = self.merged(marks)
            if len(marks) == 1:
                self.marks[marks] = after
        return ids + after

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole: list[int] = []
        find = self.known.__getitem__
        for k, x in enumerate(texts):
            if self.drops_space:
                out[k] = b"".join(map(find, x.replace("\n", " ").split(" ")))
            elif not x.replace("\n", "").isprintable() or "  " in x or "\n " in x or " \n" in x or "\n\n" in x or x[:1].isspace() or x[-1:].isspace():
                whole.append(k)
            else:  # a part that begins with a line feed stands for itself, any other for itself after a space
                first, *rest = x.replace("\n", " \n").split(" ")
                out[k] = find("\n\n" + first) + b"".join(map(find, rest))
        if whole:
            for k, x in zip(whole, self.raw([texts[k] for k in whole]), strict=True):
                out[k] = x
        return out


@lru_cache(2)
def _made(path: str) -> Encoder:
    return Encoder(path)


def _stage() -> int | None:
    task = TaskContext.get()
    return task and task.stageId()


_used: list[int | None] = [None]


def encoder(path: str) -> Encoder:
    """The vocabulary's encoder, which a worker keeps for the tasks of a stage."""
    _used[0] = _stage()
    return _made(path)


def rest() -> None:
    """Forget encoders of an earlier stage: a worker outlives its stage, and would hold their words through all later ones."""
    if _used[0] not in (None, _stage()):
        _used[0] = None
        _made.cache_clear()


def public(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
