"""The mutation log ``(key, ts, value, is_deleted)``: current and as-of views, scans, pages, change feed, compaction.

Also the version-control view of a log: ``commits(seq, parent, parent2, message)`` and ``changes(seq, key, value)``, a
null value being a deletion. Commit graphs are small and walked on the driver; values stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(log: DataFrame, order: str = "ts") -> DataFrame:
    """The last version of each key; deleted keys are absent. Of versions of one time the one of the greater hash is last."""
    last = F.struct(F.col(order), F.xxhash64("value", "is_deleted"))  # so value and flag come from one row
    rows = log.groupBy("key").agg(F.max_by("value", last).alias("value"), F.max_by("is_deleted", last).alias("gone"), F.max(order).alias(order))
    return rows.where("not gone").select("key", "value", order)


def as_of(log: DataFrame, snapshot: int) -> DataFrame:
    return current(log.where(F.col("ts") <= snapshot))


def retained(log: DataFrame, snapshot: int, versions: int = 8) -> DataFrame:
    """As-of values with ``known`` false where only ``versions`` newest versions are kept and the snapshot is older."""
    kept = log.groupBy("key").agg(F.sort_array(F.collect_list("ts"), asc=False).alias("all"))
    floor = kept.select("key", F.element_at("all", F.least(F.size("all"), F.lit(versions))).alias("floor"), (F.size("all") > versions).alias("pruned"))
    values = as_of(log, snapshot).select("key", "value")
    return floor.join(values, "key", "left").select("key", "value", (~F.col("pruned") | (F.col("floor") <= snapshot)).alias("known"))


def scan_range(view: DataFrame, start: str, end: str) -> DataFrame:
    """Keys of [start, end) in order; inverted bounds are exchanged."""
    lo, hi = min(start, end), max(start, end)
    return view.where((F.col("key") >= lo) & (F.col("key") < hi)).orderBy("key")


def scan_prefix(view: DataFrame, prefix: str) -> DataFrame:
    return view.where(F.col("key").startswith(prefix)).orderBy("key")


def page(view: DataFrame, after: str | None, count: int = 10, match: Column | None = None) -> DataFrame:
    """Keyset pagination; the match filters what the page holds, so a page may be short."""
    rows = view if after is None else view.where(F.col("key") > after)
    rows = rows.orderBy("key").limit(count)
    return rows if match is None else rows.where(match)


def changes_since(log: DataFrame, seq: int, prefixes: list[str]) -> DataFrame:
    """Events after ``seq``, one delivery for each prefix that the key has."""
    spark = log.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
    return log.where(F.col("seq") > seq).join(wanted, F.col("key").startswith(F.col("prefix"))).orderBy("seq", "prefix")


def compact(log: DataFrame, horizon: int) -> DataFrame:
    """The log with everything up to the horizon folded to one version a key (deletions dropped)."""
    old = as_of(log, horizon).withColumn("is_deleted", F.lit(False))
    return old.select("key", "ts", "value", "is_deleted").unionByName(log.where(F.col("ts") > horizon).select("key", "ts", "value", "is_deleted"))


# Version control -----------------------------------------------------------------------------------------------------
def ancestors(commits: dict[int, list[int]], seq: int) -> set[int]:
    """A commit with all before it; ``commits`` maps a number to its parents."""
    seen, stack = set(), [seq]
    while stack:
        if (c := stack.pop()) not in seen:
            seen.add(c)
            stack.extend(commits.get(c, ()))
    return seen


def graph(commits: DataFrame) -> dict[int, list[int]]:
    return {r["seq"]: [p for p in (r["parent"], r["parent2"]) if p is not None] for r in commits.select("seq", "parent", "parent2").collect()}


def resolve(graph: dict[int, list[int]], refs: dict[str, int], revision: str) -> int:
    """``name``, number, ``name~2`` or ``name^``: first parents only."""
    import re

    base, steps = re.fullmatch(r"([^~^]+)((?:~\d*|\^)*)", revision).groups()
    at = refs[base] if base in refs else int(base)
    for n in re.findall(r"~(\d*)|\^", steps):
        for _ in range(int(n) if n else 1):
            at = graph[at][0]
    return at


def view_at(changes: DataFrame, seen: set[int]) -> DataFrame:
    """(key, value) after these commits."""
    spark = changes.sparkSession
    known = F.broadcast(spark.createDataFrame([(x,) for x in sorted(seen)], "seq bigint"))
    rows = changes.join(known, "seq").groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    return rows.select("key", "v.value").where("value is not null")


def touched(changes: DataFrame, seen: set[int]) -> DataFrame:
    return changes.where(F.col("seq").isin(sorted(seen))).select("key").distinct()


def diff(changes: DataFrame, a: set[int], b: set[int]) -> DataFrame:
    """(key, before, after, kind) between two commits, looking at keys that either side alone has touched."""
    keys = touched(changes, a ^ b)
    some = changes.join(keys, "key", "left_semi")
    both = view_at(some, a).withColumnRenamed("value", "before").join(view_at(some, b).withColumnRenamed("value", "after"), "key", "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("kind", kind)


def merge(changes: DataFrame, base: set[int], ours: set[int], theirs: set[int], strategy: str | None = None) -> DataFrame:
    """Three-way merge: (key, value, conflict); ``strategy`` OURS or THEIRS settles conflicts."""
    keys = touched(changes, (ours | theirs) - base)
    some = changes.join(keys, "key", "left_semi")
    sides = [view_at(some, s).withColumnRenamed("value", n) for s, n in ((base, "b"), (ours, "o"), (theirs, "t"))]
    rows = keys
    for s in sides:
        rows = rows.join(s, "key", "left")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    conflict = ~same("o", "t") & ~same("b", "o") & ~same("b", "t")
    value = F.when(same("b", "o"), F.col("t")).when(same("b", "t") | same("o", "t"), F.col("o")).otherwise(F.col("t") if strategy == "THEIRS" else F.col("o"))
    return rows.select("key", value.alias("value"), (conflict & F.lit(strategy is None)).alias("conflict"))


def revert(changes: DataFrame, commit: int, graph: dict[int, list[int]], head: set[int]) -> DataFrame:
    """(key, value, conflict) that undoes one commit; a conflict where the key changed since."""
    before = ancestors(graph, graph[commit][0]) if graph[commit] else set()
    own = changes.where(F.col("seq") == commit).select("key", F.col("value").alias("was"))
    rows = own.join(view_at(changes, before).withColumnRenamed("value", "value"), "key", "left").join(view_at(changes, head).withColumnRenamed("value", "now"), "key", "left")
    return rows.select("key", "value", (~F.col("now").eqNullSafe(F.col("was"))).alias("conflict"))


def status(changes: DataFrame, working: DataFrame, seen: set[int]) -> DataFrame:
    """(key, kind) of a working view ``(key, value)`` against a commit: what a commit would hold; empty means clean."""
    head = view_at(changes, seen).withColumnRenamed("value", "before")
    both = head.join(working.select("key", F.col("value").alias("after")), "key", "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("key", kind.alias("kind"), "after")


def commit(changes: DataFrame, working: DataFrame, seen: set[int], seq: int, allow_empty: bool = False) -> DataFrame:
    """The change rows (seq, key, value) of a new commit; an empty one is an error unless allowed."""
    rows = status(changes, working, seen).select(F.lit(seq).cast("bigint").alias("seq"), "key", F.col("after").alias("value"))
    if not allow_empty and rows.isEmpty():
        raise ValueError("nothing to commit")
    return rows


def restore(working: DataFrame, changes: DataFrame, seen: set[int], keys: list[str]) -> DataFrame:
    """The working view with some keys as they were at a commit (absent then: gone now)."""
    old = view_at(changes, seen).where(F.col("key").isin(keys)).select("key", "value")
    return working.where(~F.col("key").isin(keys)).select("key", "value").unionByName(old)


def apply_batch(view: DataFrame, batch: DataFrame, watched: dict[str, int]) -> DataFrame | None:
    """Optimistic transaction over ``view(key, value, ts)``: None where a watched key's version moved, else the new view.

    ``batch(key, value, ts)`` is applied whole; a null value deletes.
    """
    spark = view.sparkSession
    if watched:
        asked = spark.createDataFrame(list(watched.items()), "key string, expected bigint")
        moved = asked.join(view, "key", "left").where(F.coalesce("ts", F.lit(0)) != F.col("expected"))
        if not moved.isEmpty():
            return None
    last = batch.groupBy("key").agg(F.max_by(F.struct("value"), "ts").alias("v"), F.max("ts").alias("ts"))
    new = last.select("key", "v.value", "ts")
    return view.select("key", "value", "ts").join(new, "key", "left_anti").unionByName(new.where("value is not null"))
