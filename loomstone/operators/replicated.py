"""Counters and registers that merge, clocks, reducers, cache verdicts, access rules, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions import vectors as V


def g_counter(ops: DataFrame) -> DataFrame:
    """Sum over nodes of the increments (name, node, delta)."""
    return ops.groupBy("name").agg(F.sum("delta").alias("value"))


def merge_g_counters(states: DataFrame) -> DataFrame:
    """States (name, node, count) of replicas: the greatest of each node, summed."""
    return states.groupBy("name", "node").agg(F.max("count").alias("count")).groupBy("name").agg(F.sum("count").alias("value"))


def pn_counter(ops: DataFrame) -> DataFrame:
    up, down = F.sum(F.greatest("delta", F.lit(0))), F.sum(F.greatest(-F.col("delta"), F.lit(0)))
    return ops.groupBy("name").agg((up - down).alias("value"))


def lww(ops: DataFrame) -> DataFrame:
    """The value with the greatest (ts, node)."""
    return ops.groupBy("name").agg(F.max_by("value", F.struct("ts", "node")).alias("value"))


def hlc(events: DataFrame) -> DataFrame:
    """Hybrid logical clock of each node over (node, seq, wall): physical = greatest wall so far, logical = events since it rose."""
    past = Window.partitionBy("node").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("physical", F.max("wall").over(past))
    since = Window.partitionBy("node", "physical").orderBy("seq")
    return rows.withColumn("logical", (F.row_number().over(since) - 1).cast("bigint"))


def verdicts(events: DataFrame) -> DataFrame:
    """Cache reads (seq, op, key, value) judged against the source by value: MISS, PHANTOM, HIT, STALE_HIT.

    ops: SRCSET, SRCDEL, SET, INVALIDATE, GET.
    """
    past = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cached = F.last(F.when(F.col("op").isin("SET", "INVALIDATE"), F.struct("op", "value")), ignorenulls=True).over(past)
    source = F.last(F.when(F.col("op").isin("SRCSET", "SRCDEL"), F.struct("op", "value")), ignorenulls=True).over(past)
    rows = events.withColumn("c", cached).withColumn("s", source).where("op = 'GET'")
    none = F.col("c").isNull() | (F.col("c.op") == "INVALIDATE")
    gone = F.col("s").isNull() | (F.col("s.op") == "SRCDEL")
    verdict = F.when(none, "MISS").when(gone, "PHANTOM").when(F.col("c.value").eqNullSafe(F.col("s.value")), "HIT").otherwise("STALE_HIT")
    return rows.select("seq", "key", verdict.alias("verdict"))


def allowed(command: Column, key: Column, rules: list[str], categories: dict[str, set[str]], keys: list[str]) -> Column:
    """Access by rules ``+cmd -cmd +@category -@category`` (the last that matches decides) and key patterns."""
    out = F.lit(False)
    for rule in rules:
        names = categories.get(rule[2:], set()) if rule[1] == "@" else {rule[1:]}
        match = F.lit(True) if rule[1:] == "@all" else command.isin(sorted(names))
        out = F.when(match, F.lit(rule[0] == "+")).otherwise(out)
    seen = F.lit(False)
    for pattern in keys:
        seen = seen | T.glob_match(key, pattern)
    return out & seen


def deltas(states: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Change of a vector against the one before it in each group."""
    before = F.lag(vector).over(Window.partitionBy(key).orderBy(order))
    return states.withColumn("_b", before).withColumn("delta", F.when(F.col("_b").isNull(), F.lit(0.0)).otherwise(V.proxy_delta(vector, "_b"))).drop("_b")


class Halt(Exception):
    pass


class Machine:
    """The reducer stack machine: wrapping 64-bit numbers, fuel 1 an instruction and 10 more for a load or store.

    Errors leave no writes; after three in a row a program is quarantined until ``release``.
    """

    BUDGET, STRIKES = 100_000, 3

    def __init__(self, program: list[tuple]):
        self.program, self.strikes = program, 0

    @staticmethod
    def wrap(x: int) -> int:
        return (x + 2**63) % 2**64 - 2**63

    def run(self, cells: dict) -> int | None:
        """The returned number; ``cells`` changes only when the program ends well. None while quarantined or on error."""
        if self.strikes >= self.STRIKES:
            return None
        writes, stack, at, fuel = dict(cells), [], 0, self.BUDGET
        try:
            while True:
                if not 0 <= at < len(self.program):
                    raise Halt("bad jump")
                op, *args = self.program[at]
                fuel -= 11 if op in ("LoadInt", "StoreInt") else 1
                if fuel < 0:
                    raise Halt("fuel")
                at += 1
                if op == "PushInt":
                    stack.append(self.wrap(args[0]))
                elif op == "Pop":
                    stack.pop()
                elif op == "Dup":
                    stack.append(stack[-1])
                elif op in ("Add", "Sub", "Mul"):
                    b, a = stack.pop(), stack.pop()
                    stack.append(self.wrap(a + b if op == "Add" else a - b if op == "Sub" else a * b))
                elif op == "LoadInt":
                    value = writes.get(args[0])
                    stack.append(value if isinstance(value, int) else 0)
                elif op == "StoreInt":
                    writes[args[0]] = stack.pop()
                elif op == "Jump" or (op == "JumpIfZero" and stack.pop() == 0):
                    at = args[0]
                elif op == "Return":
                    result = stack.pop()
                    break
                elif op == "Trap":
                    raise Halt("trap")
        except (Halt, IndexError):
            self.strikes += 1
            return None
        cells.update(writes)
        self.strikes = 0
        return result
