"""Time series ``(series, ts, seq, value)``: inclusive ranges, the newest points, means; buckets as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ts_range(points: DataFrame, series: str, start: int, end: int) -> DataFrame:
    """Points of [start, end] by (ts, seq); an inverted range is empty."""
    return points.where((F.col("series") == series) & F.col("ts").between(start, end)).orderBy("ts", "seq")


def latest(points: DataFrame, series: str, n: int) -> DataFrame:
    """The newest n points, oldest first."""
    return points.where(F.col("series") == series).orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq")


def average(points: DataFrame, start: int, end: int) -> DataFrame:
    """Mean of each series over [start, end]."""
    return points.where(F.col("ts").between(start, end)).groupBy("series").agg(F.avg("value").alias("mean"))


def buckets(points: DataFrame, width: int) -> DataFrame:
    """Tumbling buckets of ``width`` time units: count, mean, least, greatest, last."""
    start = (F.floor(F.col("ts") / width) * width).cast("bigint")
    return points.groupBy("series", start.alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("ts", "seq")).alias("last"))
