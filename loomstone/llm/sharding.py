"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual`` points of the ring; a row belongs to the arc that ends at the next point clockwise of its
id's hash. No shard takes more than its bound: an arc's rows are placed in hash order, the first into the arc's own
shard, and what overflows a full shard continues clockwise, arc by arc, to the next shard with room. An arc's own rows
go before rows that come from others, so a shard that is not full keeps all of its own.

What decides is the number of rows on each arc, at most shards x virtual counts, however large the table: those counts
are gathered, walked clockwise once or twice on the driver, and give for each arc a few runs of ranks with their shard
and first slot. Rows then get a rank on their arc (a window by arc; equal rows were first added up, so an id that
repeats does not make one task hold them all) and find their run by a broadcast join on that bounded table.

With ``slack`` 0 the bounds add up to the number of rows, so the counts of two shards differ by one at most (law
``rows``); with a positive slack a bound is ceil((1 + slack) x rows / shards) and fewer rows move when a shard is added.

Nulls: a null text has no bytes, a null id hashes as its own value. Equal rows are kept, each with its own slot. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
VIRTUAL = 128
#: The ring's positions: 0 up to 2**60.
HEX = 15


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    return sorted((int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:HEX], 16), s) for s in range(shards) for v in range(virtual))


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: list[int], owner: list[int], limit: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, rank after the last, shard, first slot) for the rows on each arc."""
    room, used, runs, over = list(limit), [0] * len(limit), [], [[] for _ in counts]

    def place(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            runs.append((arc, lo, lo + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return lo + n

    for arc, n in enumerate(counts):
        lo = place(arc, 0, n, owner[arc])
        if lo < n:
            over[arc].append((arc, lo, n))
    moving: list[tuple[int, int, int]] = []
    for step in range(2 * len(counts)):
        at = step % len(counts)
        while moving and room[owner[at]]:
            arc, lo, hi = moving.pop(0)
            if (lo := place(arc, lo, hi, owner[at])) < hi:
                moving.insert(0, (arc, lo, hi))
        if step < len(counts):
            moving += over[at]
    if moving:
        raise ValueError("the bounds hold fewer rows than there are")
    return runs


def shard(rows: DataFrame, key: str, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """``rows`` (narrow columns; equal rows are interchangeable) with ``shard`` and ``slot``."""
    spark, columns = rows.sparkSession, rows.columns
    points = ring(shards, virtual)
    owner = [s for _, s in points]
    position = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, HEX), 16, 10).cast("bigint")
    kept = rows.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_at", position)
    # The arc is the number of points below the position (past the last point: the first arc). The ring is cut into
    # 4096 slices: a slice's own points are compared, those before it were counted.
    shift = 4 * HEX - 12
    slices: list[list[int]] = [[] for _ in range(4096)]
    for p, _ in points:
        slices[p >> shift].append(p)
    below = [0]
    for x in slices:
        below.append(below[-1] + len(x))
    cells = spark.createDataFrame([(k, below[k], x) for k, x in enumerate(slices)], "_cell int, _below int, _inside array<bigint>")
    kept = kept.withColumn("_cell", F.shiftright("_at", shift).cast("int")).join(F.broadcast(cells), "_cell")
    arc = F.col("_below") + F.size(F.filter("_inside", lambda p: p < F.col("_at")))
    kept = kept.withColumn("_arc", (arc % len(points)).cast("int"))
    scratch = common.Scratch(spark)
    kept = scratch.table(kept.select(*columns, "_n", "_at", "_arc"), "ring")
    counts = [0] * len(points)
    for r in kept.groupBy("_arc").agg(F.sum("_n").alias("n")).collect():  # at most shards x virtual rows
        counts[r["_arc"]] = r["n"]
    runs = walk(counts, owner, bounds(sum(counts), shards, slack))
    runs_df = spark.createDataFrame([*runs, (-1, 0, 0, 0, 0)], "_arc int, _lo bigint, _hi bigint, shard int, _slot bigint")
    # A row's copies take the ranks from _first up to _first + _n.
    order = Window.partitionBy("_arc").orderBy("_at", *columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = kept.withColumn("_first", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    meets = (F.col("_first") < F.col("_hi")) & (F.col("_first") + F.col("_n") > F.col("_lo"))
    placed = ranked.join(F.broadcast(runs_df), "_arc").where(meets)
    lo, hi = F.greatest("_first", "_lo"), F.least(F.col("_first") + F.col("_n"), F.col("_hi"))
    placed = placed.withColumn("_rank", F.explode(F.sequence(lo, hi - 1)))
    out = placed.select(*columns, "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"))
    return scratch.result(out, "sharded")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
