"""Words of whole Arrow batches as numpy arrays: A-Z lower-cased, a word is a run of ASCII letters, digits and bytes from 0x80."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LOWER = np.zeros(256, np.uint8)
LOWER[0x80:] = np.arange(0x80, 0x100)
LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Bytes hashed at once; one word may be longer.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Of all words in reading order: number of the text in the batch, first byte and end within the text, 64-bit hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, and one end more."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m, made = max(n, BLOCK + 4096), []
        with np.errstate(over="ignore"):
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                steps = np.full(m, base, U64)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=U64))
        _powers[:] = made
    return _powers


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; nulls are empty."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def scan(texts: pa.Array) -> Words:
    raw, at = flat(texts)
    low = LOWER[raw]
    inside = low != 0
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    begins = at[:-1][at[:-1] < len(raw)]
    before[begins] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    ends = at[1:-1]
    after[ends[(ends > 0) & (ends <= len(raw))] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(at, start, "right") - 1
    out = np.empty(len(start), U64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(start):  # blocks end where a word ends
            j = max(k + 1, int(np.searchsorted(end, start[k] + BLOCK, "right")))
            a, b = int(start[k]), int(end[j - 1])
            up, down = _powers_to(b - a)
            total = np.zeros(b - a + 1, U64)
            np.cumsum(low[a:b] * up[: b - a], out=total[1:], dtype=U64)
            out[k:j] = mix((total[end[k:j] - a] - total[start[k:j] - a]) * down[start[k:j] - a])
            k = j
    base = at[doc] if len(doc) else at[:0]
    return Words(doc, start - base, end - base, out, len(at) - 1)


def hash_words(words: list[str]) -> np.ndarray:
    """The hash that ``scan`` gives each of these words (already lower-cased, without separators)."""
    return scan(pa.array(words, pa.string())).hash if words else np.zeros(0, U64)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within one text, and the number of each run's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U64)
        for i in range(k):
            h = h * U64(0xD6E8FEB86659FD93) + w.hash[i : i + n]
        at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
        return mix(h[at]), at


def bytes_to_chars(text: bytes) -> np.ndarray:
    """For each byte position (and the end) the number of code points before it."""
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])
