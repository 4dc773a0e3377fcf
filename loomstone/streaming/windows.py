"""Event-time aggregates with watermarks, and change feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums per window and type; in append and update mode rows later than ``late`` behind the newest are dropped.

    In complete mode every window stays, so late rows still count.
    """
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), "user_id", "n")


def change_feed(log: DataFrame, prefixes: list[str]) -> DataFrame:
    """Events of a streamed log, one for each prefix that the key has."""
    hit = F.filter(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col("key"), p))
    return log.withColumn("prefix", F.explode(hit))


def _expire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    columns = ["key", "value", "expires", "event"]
    if state.hasTimedOut:
        value, expires = state.get
        state.remove()
        yield pd.DataFrame([(key[0], value, pd.Timestamp(expires, unit="us", tz="UTC"), "expired")], columns=columns)
        return
    rows = pd.concat(list(frames)).sort_values(["ts", "value"])
    value, expires = rows["value"].iloc[-1], pd.Timestamp(rows["ts"].iloc[-1])
    expires = expires.tz_localize("UTC") if expires.tzinfo is None else expires
    deadline = int(expires.timestamp() * 1_000_000)
    if state.exists and state.get[1] >= deadline:
        return
    if deadline // 1000 <= state.getCurrentWatermarkMs():
        return  # dead on arrival
    state.update((value, deadline))
    state.setTimeoutTimestamp(deadline // 1000)
    yield pd.DataFrame([(key[0], value, expires, "set")], columns=columns)


def expiring(rows: DataFrame, late: str) -> DataFrame:
    """Streamed ``rows(key, value, ts)`` as events of each key: set with its latest deadline ``ts``, expired once the watermark passes it.

    One value a key is held until then; a row of an earlier deadline than that held, or of one that has passed, changes nothing.
    """
    kept = rows.select("key", F.col("value").cast("string").alias("value"), "ts").withWatermark("ts", late)
    return kept.groupBy("key").applyInPandasWithState(_expire, "key string, value string, expires timestamp, event string", "value string, expires bigint", "append", GroupStateTimeout.EventTimeTimeout)
