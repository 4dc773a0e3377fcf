"""The mutation log on disk: appended micro-batches, views, compaction, named snapshots.

A log is a Parquet folder with one subfolder ``batch=N`` for each append, written once, so a repeated append of the same
batch number replaces itself and readers never see half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.operators import mutations

SCHEMA = "key string, ts bigint, value double, is_deleted boolean"


class MutationLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.selectExpr("key", "cast(ts as bigint) ts", "cast(value as double) value", "is_deleted").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMA}, batch int").parquet(self.path).drop("batch")

    def current(self) -> DataFrame:
        return mutations.current(self.read())

    def as_of(self, snapshot: int) -> DataFrame:
        return mutations.as_of(self.read(), snapshot)

    def snapshot(self, name: str, horizon: int) -> str:
        """A compacted copy under ``name``; restore by reading it as a log."""
        target = f"{self.path}__{name}"
        mutations.compact(self.read(), horizon).write.mode("overwrite").parquet(f"{target}/batch=0")
        return target

    def sink(self, batch_rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: the stream's batch number makes a repeated batch harmless."""
        self.append(batch_rows, batch)
