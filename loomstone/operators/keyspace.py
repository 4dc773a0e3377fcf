"""Keyed collections as folds over command logs and as reads of their current state.

Commands whose result does not depend on order beyond "last wins", "first wins" or a sum are one aggregation each. What
does depend on the order of mixed commands goes through ``fold``, a sequential state machine per key that streams over
sorted rows, so a key with a long history needs memory for its state alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Strings -----------------------------------------------------------------------------------------------------------
def last_value(log: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """SET, HSET: the value of the last command."""
    return log.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def first_value(log: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """SET NX, HSETNX: the value of the first command."""
    return log.groupBy(*keys).agg(F.min_by(value, seq).alias(value))


def previous_value(log: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """GETSET: each command's reply is the value before it."""
    return log.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(seq)))


def running_sum(log: DataFrame, keys: list[str], delta: str = "delta", seq: str = "seq") -> DataFrame:
    """INCRBY: each command's reply is the sum so far."""
    return log.withColumn("reply", F.sum(delta).over(Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def appended(log: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """APPEND: the pieces of a key in order, and their length in bytes."""
    parts = F.array_sort(F.collect_list(F.struct(seq, value)))
    whole = log.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[value]), "").alias("value"))
    return whole.withColumn("bytes", F.octet_length("value").cast("bigint"))


def byte_range(c: Column, start: int, end: int) -> Column:
    """GETRANGE: bytes from start to end, both included, negative from the end."""
    n = F.octet_length(c)
    lo = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
    hi = F.least(n - 1, F.lit(end) if end >= 0 else n + end)
    return F.when(lo > hi, F.lit("")).otherwise(F.substring(c.cast("binary"), lo + 1, hi - lo + 1).cast("string"))


def set_range(c: Column, offset: int, piece: str) -> Column:
    """SETRANGE: overwrite from a byte offset, zero bytes where the value is shorter."""
    raw, n = c.cast("binary"), len(piece.encode())
    head = F.rpad(F.substring(raw, 1, offset), offset, F.lit(b"\x00")) if offset else F.lit(b"")
    return F.concat(head, F.lit(piece.encode()), F.substring(raw, F.lit(offset + n + 1), F.octet_length(raw)))


def ttl_seconds(expire_at: Column, now: int) -> Column:
    """TTL of deadlines in milliseconds: rounded seconds, -1 without a deadline, -2 past it."""
    return F.when(expire_at.isNull(), F.lit(-1)).when(expire_at <= now, F.lit(-2)).otherwise(F.floor((expire_at - now + 500) / 1000)).cast("bigint")


def live(rows: DataFrame, now: int) -> DataFrame:
    return rows.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def expire_allowed(old: Column, new: Column, flag: str | None) -> Column:
    """Whether EXPIRE with NX, XX, GT or LT changes a deadline; no deadline is later than any."""
    if flag == "NX":
        return old.isNull()
    if flag == "XX":
        return old.isNotNull()
    if flag == "GT":
        return old.isNotNull() & (new > old)
    if flag == "LT":
        return old.isNull() | (new < old)
    return F.lit(True)


def exists_count(asked: DataFrame, current: DataFrame) -> DataFrame:
    """EXISTS counts repeated arguments, DEL each key once."""
    hit = asked.join(current.select("key").distinct(), "key", "left_semi")
    return hit.agg(F.count("*").alias("n_exists"), F.countDistinct("key").alias("n_deleted"))


# Lists: rows (key, pos, value) with pos from 0 -----------------------------------------------------------------------
def numbered(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(order)) - 1)


def list_positions(pushes: DataFrame) -> DataFrame:
    """(key, seq, side, value) of pushes to lists: the final position of each, those to the left reversed."""
    place = F.when(F.col("side") == "L", -F.col("seq")).otherwise(F.col("seq"))
    return numbered(pushes.withColumn("_at", place), "_at").drop("_at")


def list_range(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE of every list: both ends included, negative from the tail."""
    n = F.count("*").over(Window.partitionBy("key"))
    lo = F.lit(start) if start >= 0 else F.greatest(F.lit(0), n + start)
    hi = F.lit(stop) if stop >= 0 else n + stop
    return rows.withColumn("_lo", lo).withColumn("_hi", hi).where("pos between _lo and _hi").drop("_lo", "_hi")


def list_remove(rows: DataFrame, value: Column, count: int) -> DataFrame:
    """LREM: the first (count > 0), last (count < 0) or all (0) occurrences go."""
    hit = rows.withColumn("_hit", rows["value"] == value)
    if count:
        order = F.col("pos") if count > 0 else F.desc("pos")
        nth = F.row_number().over(Window.partitionBy("key", "_hit").orderBy(order))
        hit = hit.withColumn("_hit", F.col("_hit") & (nth <= abs(count)))
    left = hit.where(~F.coalesce("_hit", F.lit(False))).drop("_hit")
    return numbered(left.withColumnRenamed("pos", "_old"), "_old").drop("_old")


def list_find(rows: DataFrame, value: Column, rank: int = 1, count: int | None = 1, most: int = 0) -> DataFrame:
    """LPOS: positions of occurrences from the rank-th on (negative: from the tail), at most ``count`` (None or 0: all)."""
    n = F.count("*").over(Window.partitionBy("key"))
    seen = rows.withColumn("_n", n).where((rows["value"] == value))
    if most:
        seen = seen.where(F.col("pos") < most if rank > 0 else F.col("pos") >= F.col("_n") - most)
    order = F.col("pos") if rank > 0 else F.desc("pos")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(order))
    seen = seen.withColumn("_nth", nth).where(F.col("_nth") >= abs(rank))
    return (seen.where(F.col("_nth") < abs(rank) + count) if count else seen).select("key", "pos")


def list_set(rows: DataFrame, index: int, value: Column) -> DataFrame:
    """LSET on every list that has the index (negative from the tail)."""
    n = F.count("*").over(Window.partitionBy("key"))
    rows = rows.withColumn("_at", F.lit(index) if index >= 0 else n + index)
    return rows.withColumn("value", F.when(F.col("pos") == F.col("_at"), value).otherwise(F.col("value"))).drop("_at")


def list_insert(rows: DataFrame, pivot: Column, value: Column, before: bool = True) -> DataFrame:
    """LINSERT next to the first occurrence of the pivot; lists without it stay."""
    first = rows.where(rows["value"] == pivot).groupBy("key").agg(F.min("pos").alias("_p"))
    new = first.select("key", (F.col("_p") - 0.5 if before else F.col("_p") + 0.5).alias("_o"), value.alias("value"))
    both = rows.select("key", F.col("pos").cast("double").alias("_o"), "value").unionByName(new)
    return numbered(both, "_o").drop("_o")


def list_move(rows: DataFrame, source: str, target: str, from_left: bool, to_left: bool) -> DataFrame:
    """LMOVE: one end of a list to one end of another; nothing happens to a missing source."""
    n = rows.where(F.col("key") == source).agg(F.max("pos").alias("n")).first()["n"]
    if n is None:
        return rows
    taken = (F.col("key") == source) & (F.col("pos") == (0 if from_left else n))
    order = F.when(taken, F.lit(-(2.0**60) if to_left else 2.0**60)).otherwise(F.col("pos").cast("double"))
    return numbered(rows.withColumn("_o", order).withColumn("key", F.when(taken, F.lit(target)).otherwise(F.col("key"))).drop("pos"), "_o").drop("_o")


def rename(view: DataFrame, source: str, target: str, only_new: bool = False) -> DataFrame:
    """RENAME, RENAMENX of a key with its value and deadline; a missing source is an error."""
    found = {r["key"] for r in view.where(F.col("key").isin(source, target)).select("key").distinct().collect()}
    if source not in found:
        raise KeyError(source)
    if source == target or (only_new and target in found):
        return view
    return view.where(F.col("key") != target).withColumn("key", F.when(F.col("key") == source, F.lit(target)).otherwise(F.col("key")))


def types(models: dict[str, DataFrame]) -> DataFrame:
    """TYPE: (key, type) of every key over the tables of each model."""
    parts = [df.select("key").distinct().withColumn("type", F.lit(name)) for name, df in models.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def set_if_none_exist(current: DataFrame, batch: DataFrame) -> DataFrame:
    """MSETNX: the batch's last values if none of its keys exists, else nothing."""
    clash = F.broadcast(batch.join(current, "key", "left_semi").agg(F.count("*").alias("_clash")))
    return last_value(batch, ["key"]).join(clash).where("_clash = 0").drop("_clash")


def random_members(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """SRANDMEMBER, SPOP: n distinct members of every set; a negative n draws with replacement."""
    if n >= 0:
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "member"), "member"))
        return rows.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")
    size = Window.partitionBy("key")
    pool = rows.withColumn("_i", F.row_number().over(size.orderBy("member")) - 1).withColumn("_size", F.count("*").over(size))
    draws = rows.groupBy("key").agg(F.count("*").alias("_size")).withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(-n))))
    draws = draws.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "key", "_d"), F.col("_size"))).drop("_size")
    return draws.join(pool.drop("_size"), ["key", "_i"]).select("key", "member")


# Sorted sets: rows (key, member, score) ------------------------------------------------------------------------------
def zadd(log: DataFrame, flag: str | None = None) -> DataFrame:
    """Scores after ZADD commands (key, member, score, seq): last, first (NX), greatest (GT) or least (LT)."""
    score = {None: F.max_by("score", "seq"), "NX": F.min_by("score", "seq"), "GT": F.max("score"), "LT": F.min("score")}[flag]
    return log.groupBy("key", "member").agg(score.alias("score"))


def zranked(rows: DataFrame) -> DataFrame:
    """With ``rank`` and ``revrank`` from 0 by (score, member)."""
    own = Window.partitionBy("key")
    rank = F.row_number().over(own.orderBy("score", "member")) - 1
    return rows.withColumn("rank", rank.cast("bigint")).withColumn("revrank", (F.count("*").over(own) - 1 - F.col("rank")).cast("bigint"))


def zrange(rows: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    """ZRANGE by index of every set; the column ``rank`` counts in the order asked for."""
    own = Window.partitionBy("key")
    n = F.count("*").over(own)
    rank = F.col("revrank") if rev else F.col("rank")
    lo = F.lit(start) if start >= 0 else F.greatest(F.lit(0), n + start)
    hi = F.lit(stop) if stop >= 0 else n + stop
    rows = zranked(rows).withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_r", rank)
    return rows.where("_r between _lo and _hi").select("key", "member", "score", F.col("_r").alias("rank"))


def bound(c: Column, text: str, low: bool) -> Column:
    """A score bound: ``5``, ``(5`` (exclusive), ``-inf``, ``+inf``."""
    exclusive = text.startswith("(")
    value = float(text.lstrip("("))
    return (c > value if exclusive else c >= value) if low else (c < value if exclusive else c <= value)


def lex_bound(c: Column, text: str, low: bool) -> Column:
    """A member bound: ``[a``, ``(a``, ``-`` or ``+``."""
    if text in "-+":
        return F.lit((text == "-") == low)
    value = text[1:]
    return (c > value if text[0] == "(" else c >= value) if low else (c < value if text[0] == "(" else c <= value)


def zrange_by_score(rows: DataFrame, low: str, high: str, offset: int = 0, count: int = -1, rev: bool = False) -> DataFrame:
    inside = rows.where(bound(F.col("score"), low, True) & bound(F.col("score"), high, False))
    order = (F.desc("score"), F.desc("member")) if rev else ("score", "member")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1
    if offset < 0:
        return inside.where("false")
    kept = inside.withColumn("_n", nth).where(F.col("_n") >= offset)
    return (kept if count < 0 else kept.where(F.col("_n") < offset + count)).drop("_n")


def zpop(rows: DataFrame, n: int, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, left) of ZPOPMIN or ZPOPMAX n on every set."""
    rank = "revrank" if largest else "rank"
    ranks = zranked(rows)
    return ranks.where(F.col(rank) < n), ranks.where(F.col(rank) >= n).drop("rank", "revrank")


# Sets: rows (key, member) --------------------------------------------------------------------------------------------
def members(log: DataFrame) -> DataFrame:
    """(key, member) whose last command (key, member, op, seq) was ``add``."""
    return log.groupBy("key", "member").agg(F.max_by("op", "seq").alias("op")).where("op = 'add'").drop("op")


def set_algebra(rows: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """SUNION, SINTER, SDIFF of some keys; a missing key is an empty set."""
    parts = [rows.where(F.col("key") == k).select("member").distinct() for k in keys]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x).distinct() if op == "union" else out.join(x, "member", "left_semi" if op == "inter" else "left_anti")
    return out


# The general fold ----------------------------------------------------------------------------------------------------
def fold(log: DataFrame, step: Callable[[dict, dict], str | None], key: str = "key", seq: str = "seq") -> DataFrame:
    """Replies (key, seq, reply) of order-dependent commands; ``step(state, row)`` changes the key's state.

    Rows of a key are sorted and streamed: what a task holds is one batch and one key's state.
    """
    schema = f"{key} {dict(log.dtypes)[key]}, {seq} {dict(log.dtypes)[seq]}, reply string"
    kinds = pa.schema([(key, pa.string() if dict(log.dtypes)[key] == "string" else pa.int64()), (seq, pa.int64() if dict(log.dtypes)[seq] == "bigint" else pa.int32()), ("reply", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], {}
                out.append({key: row[key], seq: row[seq], "reply": step(state, row)})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return log.repartition(key).sortWithinPartitions(key, seq).mapInArrow(run, schema)


def list_step(state: dict, row: dict) -> str | None:
    """LPUSH, RPUSH, LPOP, RPOP, LLEN over ``cmd`` and ``value``."""
    from collections import deque

    items, cmd = state.setdefault("items", deque()), row["cmd"]
    if cmd in ("LPUSH", "RPUSH"):
        (items.appendleft if cmd == "LPUSH" else items.append)(row["value"])
        return str(len(items))
    if cmd in ("LPOP", "RPOP"):
        return (items.popleft if cmd == "LPOP" else items.pop)() if items else None
    return str(len(items))


def string_step(state: dict, row: dict) -> str | None:
    """SET, SETNX, SETXX, GET, GETDEL, APPEND, INCRBY, DEL over ``cmd`` and ``value``."""
    cmd, value = row["cmd"], row["value"]
    old = state.get("v")
    if cmd == "GET":
        return old
    if cmd in ("GETDEL", "DEL"):
        state.pop("v", None)
        return old if cmd == "GETDEL" else str(int(old is not None))
    if (cmd == "SETNX" and old is not None) or (cmd == "SETXX" and old is None):
        return None
    if cmd == "INCRBY":
        if old is not None and str(int(old) if old.lstrip("-").isdigit() else "") != old:
            return "ERR"
        state["v"] = str(int(old or 0) + int(value))
        return state["v"]
    state["v"] = (old or "") + value if cmd == "APPEND" else value
    return str(len(state["v"].encode())) if cmd == "APPEND" else "OK"
