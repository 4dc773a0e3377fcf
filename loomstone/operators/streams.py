"""Streams ``(key, id_ms, id_seq, ...)`` with consumer groups, and channels with subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as T


def monotonic(entries: DataFrame, order: str) -> DataFrame:
    """XADD: ``accepted`` where the id is above every accepted id before it (ids that fail do not count)."""
    past = Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ident = F.struct("id_ms", "id_seq")
    top = F.max(ident).over(past)
    return entries.withColumn("accepted", top.isNull() | (ident > top))


def parse_id(text: str, low: bool) -> tuple[int, int, bool]:
    """(ms, seq, exclusive) of ``5``, ``5-1``, ``(5-1``, ``-`` or ``+``; a missing seq is the least or the greatest."""
    if text == "-":
        return 0, 0, False
    if text == "+":
        return 2**63 - 1, 2**63 - 1, False
    exclusive = text.startswith("(")
    ms, _, seq = text.lstrip("(").partition("-")
    return int(ms), int(seq) if seq else (0 if low else 2**63 - 1), exclusive


def _above(text: str) -> Column:
    ms, seq, ex = parse_id(text, True)
    tail = F.col("id_seq") > seq if ex else F.col("id_seq") >= seq
    return (F.col("id_ms") > ms) | ((F.col("id_ms") == ms) & tail)


def _below(text: str) -> Column:
    ms, seq, ex = parse_id(text, False)
    tail = F.col("id_seq") < seq if ex else F.col("id_seq") <= seq
    return (F.col("id_ms") < ms) | ((F.col("id_ms") == ms) & tail)


def xrange(entries: DataFrame, key: str, start: str, end: str, count: int | None = None, rev: bool = False) -> DataFrame:
    rows = entries.where((F.col("key") == key) & _above(start) & _below(end))
    rows = rows.orderBy(F.desc("id_ms"), F.desc("id_seq")) if rev else rows.orderBy("id_ms", "id_seq")
    return rows if count is None else rows.limit(count)


def xread(entries: DataFrame, after: dict[str, str], count: int) -> DataFrame:
    """Up to ``count`` entries of each stream after an id."""
    spark = entries.sparkSession
    cursors = F.broadcast(spark.createDataFrame([(k, *parse_id(v, True)[:2]) for k, v in after.items()], "key string, c_ms bigint, c_seq bigint"))
    rows = entries.join(cursors, "key").where("id_ms > c_ms or (id_ms = c_ms and id_seq > c_seq)").drop("c_ms", "c_seq")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id_ms", "id_seq"))
    return rows.withColumn("_n", nth).where(F.col("_n") <= count).drop("_n")


def xtrim(entries: DataFrame, maxlen: int | None = None, minid: str | None = None) -> DataFrame:
    if minid is not None:
        return entries.where(_above(minid))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("id_ms"), F.desc("id_seq")))
    return entries.withColumn("_n", nth).where(F.col("_n") <= maxlen).drop("_n")


def deliver(entries: DataFrame, consumers: list[str], batch: int) -> DataFrame:
    """XREADGROUP ``>`` by consumers in turn, ``batch`` entries each: with ``consumer``."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id_ms", "id_seq")) - 1
    names = F.array(*[F.lit(c) for c in consumers])
    turn = F.pmod(F.floor(nth / batch), F.lit(len(consumers))).cast("int")
    return entries.withColumn("consumer", F.get(names, turn))


def pending(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """Deliveries (key, id_ms, id_seq, consumer, at, count) that no ack answers."""
    last = deliveries.groupBy("key", "id_ms", "id_seq").agg(F.max_by(F.struct("consumer", "at"), "at").alias("d"), F.count("*").alias("times"))
    return last.select("key", "id_ms", "id_seq", "d.consumer", "d.at", "times").join(acks.select("key", "id_ms", "id_seq").distinct(), ["key", "id_ms", "id_seq"], "left_anti")


def pending_summary(rows: DataFrame) -> DataFrame:
    """XPENDING: per stream the number, first and last id; per consumer the number."""
    ident = F.struct("id_ms", "id_seq")
    return rows.groupBy("key", "consumer").agg(F.count("*").alias("n"), F.min(ident).alias("first"), F.max(ident).alias("last"))


def claim(rows: DataFrame, consumer: str, idle: int, now: int, count: int | None = None) -> DataFrame:
    """XCLAIM, XAUTOCLAIM: entries idle for ``idle`` go to a consumer, the oldest ids first."""
    due = rows.where(F.lit(now) - F.col("at") >= idle).orderBy("key", "id_ms", "id_seq")
    due = due if count is None else due.limit(count)
    return due.withColumn("consumer", F.lit(consumer)).withColumn("at", F.lit(now)).withColumn("times", F.col("times") + 1)


def group_info(entries: DataFrame, deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """XINFO: per stream its length, last id, entries read, pending and lag."""
    made = entries.groupBy("key").agg(F.count("*").alias("length"), F.max(F.struct("id_ms", "id_seq")).alias("last"))
    read = deliveries.select("key", "id_ms", "id_seq").distinct().groupBy("key").agg(F.count("*").alias("entries_read"))
    left = pending(deliveries, acks).groupBy("key").agg(F.count("*").alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = made.join(read, "key", "left").join(left, "key", "left").select("key", "length", "last.id_ms", "last.id_seq", zero("entries_read"), zero("pending"))
    return rows.withColumn("lag", F.col("length") - F.col("entries_read"))


def publish(messages: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(msg, subscriber) deliveries, one for each matching subscription: exact channels and glob patterns."""
    rows = messages.join(exact, "channel").select("msg", "channel", "subscriber")
    for subscriber, pattern in patterns:
        rows = rows.unionByName(messages.where(T.glob_match(F.col("channel"), pattern)).select("msg", "channel", F.lit(subscriber).alias("subscriber")))
    return rows
