"""Benchmark decontamination by a generalised suffix automaton of the normalised items.

Words are runs of ASCII letters (lower-cased), digits and characters from U+0080. The automaton holds every run of words
of every item; the words of a document stream through it, and at each word the length of the longest run ending there
that is part of some item is known. A run of ``window`` words or more (an item with fewer words counts as one window) is
a hit: its words are marked, and the items that hold it are found at the automaton's state.

Only stretches of words that all occur in the items and are as long as the shortest window can hold a hit, so only they
stream through the automaton; finding them is one vectorised pass over the batch. The automata are built from blocks of
at most BLOCK_WORDS item words, so what is broadcast has a bound; more blocks mean one pass over the documents each,
each adding to the marks of the one before.

Nulls: a null text, of a document or an item, has no words. An item without words has no window. A null item_id is the
string "null". Rows that repeat a doc_id are kept apart. Empty tables give empty results; without items nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

WINDOW = 13
#: Item words in one automaton: some 400 bytes a word where it is held.
BLOCK_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, ws in items:
            if ws:
                coded.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]))
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in coded)], default=window)
        #: For each state the items whose windows end there, by window length; most states have none.
        self.items: dict[int, dict[int, set[str]]] = {}
        for name, ids in coded:
            n = min(window, len(ids))
            for state in self._windows(ids, n):
                self.items.setdefault(state, {}).setdefault(n, set()).add(name)
        #: For each state the nearest one at or above it (along suffix links) that ends a window.
        self.ends = [-1] * len(self.link)
        for v in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.ends[v] = v if v in self.items else self.ends[self.link[v]] if v else -1
        self.hashes = words.hash_words(list(self.vocabulary))
        order = np.argsort(self.hashes)
        self.hashes, self.numbers = self.hashes[order], order.astype(np.int64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            cur = self._state(length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p < 0:
                return cur
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            return cur
        return self._clone(last, c, q)

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(nxt)
        self.link.append(link)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _windows(self, ids: list[int], n: int) -> Iterator[int]:
        """The state of each run of n words of an item."""
        v, m = 0, 0
        for c in ids:
            v, m = self.step(v, m, c)
            while v and self.length[self.link[v]] >= n:
                v = self.link[v]
            if (m := min(m, self.length[v])) >= n:
                yield v

    def step(self, v: int, m: int, c: int) -> tuple[int, int]:
        """From state v with m words matched over word c."""
        nxt = self.next
        while v and c not in nxt[v]:
            v = self.link[v]
            m = self.length[v]
        if c in nxt[v]:
            return nxt[v][c], m + 1
        return 0, 0

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(index of the word, words of the longest window ending there, its state) for each word that ends a window."""
        v, m, nxt, link, length, ends = 0, 0, self.next, self.link, self.length, self.ends
        for i, c in enumerate(ids):
            while v and c not in nxt[v]:
                v = link[v]
                m = length[v]
            if c in nxt[v]:
                v, m = nxt[v][c], m + 1
                e = ends[v]
                while e >= 0:
                    fits = [n for n in self.items[e] if n <= m]
                    if fits:
                        yield i, max(fits), e
                    e = ends[link[e]] if e else -1
            else:
                v = m = 0

    def numbered(self, w: words.Words) -> np.ndarray:
        """Each word's number, -1 for words of no item."""
        out = np.full(len(w.hash), -1, np.int64)
        if not len(self.hashes):
            return out
        maybe = np.flatnonzero(self.seen[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        h = w.hash[maybe]
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[k] == h
        out[maybe[same]] = self.numbers[k[same]]
        return out

    def hits(self, w: words.Words, texts: list[bytes]) -> Iterator[tuple[int, list[int], set[str]]]:
        """(text, its marked words, items found) for each text of the batch with hits."""
        ids = self.numbered(w)
        inside = ids >= 0
        same = np.ones(len(ids), bool)
        same[1:] = w.doc[1:] == w.doc[:-1]
        joined = np.zeros(len(ids) + 1, bool)
        joined[1:-1] = inside[1:] & inside[:-1] & same[1:]
        begin = np.flatnonzero(inside & ~joined[:-1])
        end = np.flatnonzero(inside & ~joined[1:]) + 1
        long = end - begin >= self.shortest
        first = w.bounds()
        names = list(self.vocabulary)
        found: dict[int, tuple[set[int], set[str]]] = {}
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            doc, good = int(w.doc[a]), None
            for i, n, state in self.stream(ids[a:b].tolist()):
                at = range(a + i - n + 1, a + i + 1)
                if good is None:  # the hash found the words; their letters decide
                    good = [texts[doc][w.start[x] : w.end[x]].translate(_FOLD).decode() == names[ids[x]] for x in range(a, b)]
                if not all(good[i - n + 1 : i + 1]):
                    continue
                marked, items = found.setdefault(doc, (set(), set()))
                marked.update(int(x - first[doc]) for x in at)
                for m, who in self.items[state].items():
                    if m <= n:
                        items |= who
        for doc, (marked, items) in found.items():
            yield doc, sorted(marked), items


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """One automaton for each block of items; items arrive one at a time, so the driver holds one block."""
    block: list[tuple[str, list[str]]] = []
    held = 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").distinct()
    for r in rows.toLocalIterator():
        ws = split(r["text"])
        if held and held + len(ws) > block_words:
            yield Automaton(block, window)
            block, held = [], 0
        block.append((r["item_id"], ws))
        held += len(ws)
    yield Automaton(block, window)


FOUND = "doc_id bigint, text string, n_words bigint, marked array<int>, items array<string>"


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: number of words, marked words (their numbers), items found."""
    spark = docs.sparkSession
    nothing = F.lit(None).cast("array<string>")
    rows = common.filled(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("n_words"), nothing.cast("array<int>").alias("marked"), nothing.alias("items"))
    for a in automata(items, window, block_words):
        held = spark.sparkContext.broadcast(a)

        def mark(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            a = held.value
            for batch in common.slices(batches, "text"):
                w = words.scan(batch.column("text"))
                counts = np.diff(w.bounds())
                marked, found = (batch.column(c).to_pylist() for c in ("marked", "items"))
                for doc, ms, who in a.hits(w, _Texts(batch.column("text"))):
                    marked[doc] = sorted({*(marked[doc] or ()), *ms})
                    found[doc] = sorted({*(found[doc] or ()), *who})
                yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(marked, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "marked", "items"])

        rows = rows.mapInArrow(mark, FOUND)
    return rows.select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("marked", "array<int>"), ("items", "array<string>"))))


class _Texts:
    """Bytes of a text by its number, read only when asked for."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __getitem__(self, k: int) -> bytes:
        if getattr(self, "_at", None) != k:
            self._at, self._raw = k, self.column[k].as_py().encode()
        return self._raw


def report(found: DataFrame) -> DataFrame:
    n = F.size("marked").cast("bigint")
    return found.select(
        "doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n > 0) & (n * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` with every hit span cut out of the text (and ``n_chars``, where there is one, counted anew).

    A row goes when more than the share ``most`` of its words was hit. Rows without a hit stay as they are.
    """
    schema, columns = docs.schema, docs.columns
    # The row travels as one struct, so no name of its columns can clash.
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    rows = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = [docs.sparkSession.sparkContext.broadcast(a) for a in automata(items, window, block_words)]

    # One function for all blocks and the cuts: a function of its own for each would be as many Python workers at once for each task.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            w, texts = words.scan(batch.column("text")), _Texts(batch.column("text"))
            first, every = w.bounds(), {}
            for a in held:  # marks are of the uncut text in every block
                for doc, ms, _ in a.value.hits(w, texts):
                    every.setdefault(doc, set()).update(ms)
            new = {}
            for doc, marked in every.items():
                lo, hi = first[doc], first[doc + 1]
                if len(marked) > most * (hi - lo):
                    new[doc] = None
                    continue
                start, end = w.start[lo:hi], w.end[lo:hi]
                raw, at, kept = texts[doc], 0, []
                for x, y in runs(sorted(marked)):
                    kept.append(raw[at : start[x]])
                    at = end[y - 1]
                new[doc] = b"".join([*kept, raw[at:]]).decode()
            yield replaced(pa.RecordBatch.from_arrays(batch.column("row").flatten(), names=columns), new)

    return rows.mapInArrow(cut, schema)


def runs(marked: list[int]) -> Iterator[tuple[int, int]]:
    """[first, after the last) of each stretch of consecutive numbers."""
    lo = hi = None
    for x in marked:
        if hi == x:
            hi += 1
            continue
        if lo is not None:
            yield lo, hi
        lo, hi = x, x + 1
    if lo is not None:
        yield lo, hi


def replaced(batch: pa.RecordBatch, new: dict[int, str | None]) -> pa.RecordBatch:
    """The batch with these texts exchanged (None: the row goes) and n_chars following."""
    if not new:
        return batch
    texts = batch.column("text").to_pylist()
    for k, x in new.items():
        texts[k] = x
    columns = {n: batch.column(n) for n in batch.schema.names}
    columns["text"] = pa.array(texts, batch.schema.field("text").type)
    if "n_chars" in columns:
        chars = columns["n_chars"].to_pylist()
        for k, x in new.items():
            chars[k] = None if x is None else len(x)
        columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
    out = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
    return out.filter(pa.array([new.get(k, "") is not None for k in range(batch.num_rows)]))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")))
