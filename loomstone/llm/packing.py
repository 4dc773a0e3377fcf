"""Packing by non-negative least squares over shallow length combinations.

A document of n tokens gives n // 4096 full windows and a remainder. Remainders are what needs packing: their exact
lengths form a histogram of at most 4095 counts, whatever the size of the corpus. Lengths are rounded up to GRAIN
tokens. A combination is some copies of one length closed by copies of a second one or by two single ones, so that the
window is full; it has three lengths at most but may hold many short documents. Repeat counts are the non-negative
least-squares solution against the histogram (an active set, so no more combinations than lengths are used), rounded
under what each length still has; what is left is solved for again, up to PASSES times.

Remainders that no combination takes are packed greedily on a line: it first fills the room that rounding lengths up has
left in the sequences (where that is FILL tokens or more), then it is cut at every 4096 tokens, and the rest becomes
sequences whose lengths are powers of two, which need no padding. If the line is shorter than the room, some repeats of
every combination are given to the line.

A document's place depends only on the histogram and on its rank among the remainders of the same length. The rank is
its number within its input partition plus the counts of the partitions before; these come as one row of at most 4096
numbers to each partition, in one shuffle of ids by partition. So nothing is sorted or gathered by length, and a length
that a third of all documents share costs no more than any other. Partners in a sequence find each other's lengths from
the histogram too, so offsets need no shuffle.

Nulls: a null text is empty and has the end id alone. A null doc_id is one like others. Very long texts fill windows of
their own. Repeated rows are packed each; rows of one length are told apart by their order in the input. An empty table
gives no pieces. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

LENGTH, GRAIN = 4096, 16
#: Least room in a sequence that the line fills; less is padding.
FILL, PASSES = 16, 4
ENCODED = "part int, doc_id bigint, n bigint, rest int, rank bigint, fulls bigint, ids binary"


@lru_cache(2)
def combinations(parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths (three a row, 0: none) and copies of every combination that sums to ``parts``."""
    rows = set()
    for a in range(1, parts + 1):
        for i in range(1, parts // a + 1):
            rest = parts - i * a
            if not rest:
                rows.add(((a, i),))
            for b in range(1, rest // 2 + 1):
                got = {a: i}
                for x in (b, rest - b):
                    got[x] = got.get(x, 0) + 1
                rows.add(tuple(sorted(got.items())))
            for b in range(1, rest + 1):
                if not rest % b and b != a:
                    rows.add(tuple(sorted(((a, i), (b, rest // b)))))
    held = np.zeros((len(rows), 3, 2), np.int64)
    for k, row in enumerate(sorted(rows)):
        held[k, : len(row)] = row
    return held[..., 0], held[..., 1]


def nnls(lengths: np.ndarray, copies: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that bring their sum nearest to the counts by length, by active sets."""
    n = len(counts)
    norm = np.sqrt((copies**2).sum(1))
    matrix, active, x = np.zeros((n, 0)), np.zeros(0, np.int64), np.zeros(0)
    rest, least = counts.astype(float), 1e-6 * (1 + np.abs(counts).max(initial=0))
    for _ in range(3 * n):
        slope = (copies * rest[lengths]).sum(1) / norm
        slope[active] = -np.inf
        best = int(slope.argmax()) if len(slope) else -1
        if best < 0 or slope[best] <= least:
            break
        column = np.zeros((n, 1))
        np.add.at(column[:, 0], lengths[best], copies[best])
        matrix, active, x = np.hstack([matrix, column]), np.append(active, best), np.append(x, 0.0)
        while True:
            z = np.linalg.solve(matrix.T @ matrix + 1e-9 * np.eye(len(active)), matrix.T @ counts)
            if z.min() > 0:
                x = z
                break
            down = z <= 0
            ratio = (x[down] / np.maximum(x[down] - z[down], 1e-300)).min()
            x = x + ratio * (z - x)
            keep = x > 1e-9
            matrix, active, x = matrix[:, keep], active[keep], x[keep]
            if not len(active):
                break
        rest = counts - matrix @ x
    out = np.zeros(len(lengths))
    out[active] = x
    return out


class Plan(NamedTuple):
    """Where the k-th remainder by length goes; a few arrays bounded by the window's length and the combinations used."""

    hist: np.ndarray  # remainders of each exact length
    before: np.ndarray  # remainders shorter than each length, in the order of all by length
    tokens_before: np.ndarray  # and their tokens
    lengths: np.ndarray  # of each combination used its lengths in grains, copies
    copies: np.ndarray
    repeats: np.ndarray
    base: np.ndarray  # where its run of each length begins in that order
    first_sequence: np.ndarray
    run_base: np.ndarray  # all runs in order: where they begin and end, their combination and which of its lengths
    run_end: np.ndarray
    run_combo: np.ndarray
    run_slot: np.ndarray
    sequences: int
    line_at: np.ndarray  # of each length, where its left-over remainders begin on the line, and how many were taken
    taken: np.ndarray
    line: int
    room: np.ndarray  # stretches of sequences with equal room that the line fills: tokens of the line before, first sequence,
    room_sequence: np.ndarray  # room of each,
    room_size: np.ndarray  # and all the room

    room_total: int

    def tokens_to(self, rank: np.ndarray) -> np.ndarray:
        """Tokens of the remainders before this place in the order by length."""
        length = np.searchsorted(self.before, rank, "right") - 1
        return self.tokens_before[length] + (rank - self.before[length]) * length


def plan(hist: np.ndarray) -> Plan:
    """The packing of remainders with these counts by exact length (index 0 unused)."""
    bins = -(-np.arange(LENGTH) // GRAIN)
    n_bins = LENGTH // GRAIN + 1
    counts = np.bincount(bins, hist, n_bins).astype(np.int64)
    lengths, copies = combinations(n_bins - 1)
    left, repeats = counts.copy(), np.zeros(len(lengths), np.int64)
    for _ in range(PASSES):
        x, placed = nnls(lengths, copies, left), 0
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            used = copies[k] > 0
            if n := min(round(x[k]), int((left[lengths[k][used]] // copies[k][used]).min())):
                left[lengths[k][used]] -= n * copies[k][used]
                repeats[k] += n
                placed += n
        if 100 * placed <= repeats.sum():  # hardly more
            break
    chosen = np.flatnonzero(repeats)
    made = _placed(hist, lengths[chosen], copies[chosen], repeats[chosen])
    while made.line < made.room_total and made.sequences:
        made = _placed(hist, made.lengths, made.copies, made.repeats - -(-made.repeats // 16))
    return made


def _placed(hist: np.ndarray, lengths: np.ndarray, copies: np.ndarray, repeats: np.ndarray) -> Plan:
    some = repeats > 0
    lengths, copies, repeats = lengths[some], copies[some], repeats[some]
    exact = np.arange(LENGTH)
    bins = -(-exact // GRAIN)
    n_bins = LENGTH // GRAIN + 1
    before = np.concatenate([[0], np.cumsum(hist)])[:-1]
    tokens_before = np.concatenate([[0], np.cumsum(hist * exact)])[:-1]
    bin_at = np.concatenate([[0], np.cumsum(np.bincount(bins, hist, n_bins).astype(np.int64))])[:-1]
    used, base, runs = np.zeros(n_bins, np.int64), np.zeros_like(lengths), []
    for c in range(len(lengths)):
        for slot in range(3):
            if copies[c, slot]:
                b, n = lengths[c, slot], copies[c, slot] * repeats[c]
                base[c, slot] = bin_at[b] + used[b]
                runs.append((base[c, slot], base[c, slot] + n, c, slot))
                used[b] += n
    runs = np.array(sorted(runs), np.int64).reshape(-1, 4)
    first = np.concatenate([[0], np.cumsum(repeats)])
    taken = np.clip(used[bins] - (before - bin_at[bins]), 0, hist)
    line = np.concatenate([[0], np.cumsum((hist - taken) * exact)])
    made = Plan(hist, before, tokens_before, lengths, copies, repeats, base, first[:-1], *runs.T, int(first[-1]), line[:-1], taken, int(line[-1]), *([np.zeros(0, np.int64)] * 3), 0)
    rooms = []
    for c in range(len(lengths)):
        # Lengths rise along a run, so the lengths of a repeat change a bounded number of times.
        turns = {0, int(repeats[c])}
        for slot in np.flatnonzero(copies[c]):
            lo, m = base[c, slot], copies[c, slot]
            inside = before[(before > lo) & (before < lo + m * repeats[c])] - lo
            turns.update((inside // m).tolist())
            turns.update((inside // m + 1).tolist())
        turns = np.array(sorted(t for t in turns if t <= repeats[c]))
        size = np.zeros(len(turns) - 1, np.int64)
        for slot in np.flatnonzero(copies[c]):
            at = base[c, slot] + turns[:-1] * copies[c, slot]
            size += made.tokens_to(at + copies[c, slot]) - made.tokens_to(at)
        rooms += [(first[c] + t, n, LENGTH - x) for t, n, x in zip(turns[:-1], np.diff(turns), size, strict=True) if LENGTH - x >= FILL]
    rooms = np.array(rooms, np.int64).reshape(-1, 3)
    room = np.concatenate([[0], np.cumsum(rooms[:, 1] * rooms[:, 2])])
    return made._replace(room=room[:-1], room_sequence=rooms[:, 0], room_size=rooms[:, 2], room_total=int(room[-1]))


def locate(p: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For remainders by length and rank in it: whether a combination has it, its sequence and offset, or its place on the line."""
    k = p.before[length] + rank
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    run = np.searchsorted(p.run_base, k, "right") - 1
    packed = (run >= 0) & (k < p.run_end[run]) if len(p.run_base) else np.zeros(len(length), bool)
    if packed.any():
        k_in, run = k[packed], run[packed]
        combo, slot = p.run_combo[run], p.run_slot[run]
        own = p.copies[combo, slot]
        repeat = (k_in - p.run_base[run]) // own
        sequence[packed] = p.first_sequence[combo] + repeat
        total = p.tokens_to(k_in) - p.tokens_to(p.run_base[run] + repeat * own)
        for t in range(2):  # the lengths in the slots before
            m = p.copies[combo, t]
            at = p.base[combo, t] + repeat * m
            total += np.where(slot > t, p.tokens_to(at + m) - p.tokens_to(at), 0)
        offset[packed] = total
    return packed, sequence, offset, p.line_at[length] + (rank - p.taken[length]) * length


class Line:
    """Cuts stretches of the line into pieces: rooms in the sequences of combinations first, then windows, then powers of two."""

    def __init__(self, p: Plan):
        self.p, self.rooms, self.rest = p, p.room.tolist(), max(0, p.line - p.room_total)
        self.windows = self.rest // LENGTH
        self.tail = cuts(self.rest).tolist()

    def pieces(self, at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(tokens, sequence after those of full windows, offset) of the stretch."""
        p = self.p
        while at < end:
            if at < p.room_total:
                k = bisect_right(self.rooms, at) - 1
                size = int(p.room_size[k])
                s, into = divmod(at - self.rooms[k], size)
                m = min(end - at, size - into)
                yield m, int(p.room_sequence[k]) + s, LENGTH - size + into
            else:
                x = at - p.room_total
                s, into = divmod(x, LENGTH)
                m = LENGTH - into
                if s >= self.windows:
                    t = bisect_right(self.tail, x) - 1
                    s, into, m = self.windows + t, x - self.tail[t], self.tail[t + 1] - x
                m = min(end - at, m)
                yield m, p.sequences + s, into
            at += m


def cuts(line: int) -> np.ndarray:
    """Starts of the sequences after the last full window of the line: descending powers of two, and its end."""
    at, out = line // LENGTH * LENGTH, []
    rest = line - at
    for e in reversed(range(LENGTH.bit_length())):
        if rest >> e & 1:
            out.append(at)
            at += 1 << e
    return np.array([*out, line], np.int64)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of each document with the end id, the length of its remainder and its number in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokens.encoder(vocabulary), TaskContext.get().partitionId()
        seen, fulls = np.zeros(LENGTH, np.int64), 0
        for batch in common.slices(batches, "text", 4 << 20):
            ids = [x + enc.end for x in enc.encode(batch.column("text").to_pylist())]
            n = [len(x) // enc.dtype.itemsize for x in ids]
            rank, full = [], []
            for x in n:
                rank.append(int(seen[x % LENGTH]))
                full.append(fulls)
                seen[x % LENGTH] += 1
                fulls += x // LENGTH
            yield pa.record_batch([pa.array([part] * len(n), pa.int32()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([x % LENGTH for x in n], pa.int32()), pa.array(rank, pa.int64()), pa.array(full, pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "n", "rest", "rank", "fulls", "ids"])

    return common.filled(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ENCODED)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, vocabulary: str, scratch: common.Scratch, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``; ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers."""
    spark = docs.sparkSession
    rows = scratch.table(encode(docs, vocabulary), "encoded")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition and length; what meets for one length is one row of each partition.
    counts = scratch.table(rows.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum(F.expr(f"n div {LENGTH}")).alias("f")), "lengths")
    hist = np.zeros(LENGTH, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # at most one row for each length
        hist[r["rest"]] = r["c"]
    hist[0] = 0
    p = plan(hist)
    n_full = int(counts.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0])
    by_length = counts.select("part", "rest", F.coalesce(F.sum("c").over(earlier.partitionBy("rest").orderBy("part")), F.lit(0)).alias("ranks"))
    by_length = by_length.groupBy("part").agg(F.collect_list(F.struct("rest", "ranks")).alias("ranks"))
    by_part = counts.groupBy("part").agg(F.sum("f").alias("f"))
    by_part = by_part.select("part", F.coalesce(F.sum("f").over(earlier.orderBy("part")), F.lit(0)).alias("fulls"))
    heads = by_length.join(by_part, "part").select("part", F.lit(0).alias("kind"), "ranks", "fulls", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("n", "bigint"), ("rest", "int"), ("rank", "bigint"), ("ids", "binary"))))
    heads = scratch.table(heads, "heads")
    tails = rows.select("part", F.lit(1).alias("kind"), F.lit(None).cast(heads.schema["ranks"].dataType).alias("ranks"), "fulls", "doc_id", "n", "rest", "rank", "ids")
    held = spark.sparkContext.broadcast((p, n_full))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n_full = held.value
        line, before, fulls_before = Line(p), np.zeros(LENGTH, np.int64), 0
        for batch in common.slices(batches, "ids"):
            kind = batch.column("kind").to_numpy()
            rest = pa.compute.fill_null(batch.column("rest"), 0).to_numpy().astype(np.int64)
            rank = pa.compute.fill_null(batch.column("rank"), 0).to_numpy().astype(np.int64)
            fulls = batch.column("fulls").to_numpy().astype(np.int64)
            edge = [*np.flatnonzero(kind == 0).tolist(), len(kind)]
            for lo, hi in zip([-1, *edge[:-1]], edge, strict=True):
                if lo >= 0:
                    before, fulls_before = np.zeros(LENGTH, np.int64), int(fulls[lo])
                    for x in batch.column("ranks")[lo].as_py():
                        before[x["rest"]] = x["ranks"]
                rank[lo + 1 : hi] += before[rest[lo + 1 : hi]]
                fulls[lo + 1 : hi] += fulls_before
            docs = batch.filter(pa.array(kind == 1))
            rest, rank, fulls = rest[kind == 1], rank[kind == 1], fulls[kind == 1]
            packed, sequence, offset, place = (x.tolist() for x in locate(p, rest, rank))
            out: list[list] = [[] for _ in range(8)]
            for k, (doc, n, raw) in enumerate(zip(*(docs.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True)):
                r = int(rest[k])
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                pieces = [(j * LENGTH, LENGTH, int(fulls[k]) + j, 0) for j in range(n // LENGTH)]
                if r and packed[k]:
                    pieces.append((n - r, r, n_full + sequence[k], offset[k]))
                elif r:
                    at = n - r
                    for m, s, o in line.pieces(place[k], place[k] + r):
                        pieces.append((at, m, n_full + s, o))
                        at += m
                for start, m, s, o in pieces:
                    raw = ids[start : start + m].tobytes()
                    for column, x in zip(out, (doc, start, m, zlib.crc32(raw), n, s, o, raw if with_ids else None), strict=True):
                        column.append(x)
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    dealt = heads.unionByName(tails).repartition("part").sortWithinPartitions("part", "kind")
    pieces = dealt.select("kind", "ranks", "fulls", "doc_id", "n", "rest", "rank", "ids").mapInArrow(cut, PIECES)
    return pieces if with_ids else pieces.drop("ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = common.Scratch(spark)
    return s.result(pack(common.read(spark, sf_dir, "documents"), tokens.public("word_bpe_49k.json"), s, with_ids=False), "pieces")
