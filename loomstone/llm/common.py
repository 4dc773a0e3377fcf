"""What the operators of this subpackage share: shared scratch tables, null handling, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

#: Rows that Spark puts in one Arrow batch, so that long texts do not make batches of gigabytes.
ROWS_PER_BATCH = 500
BYTES_PER_BATCH = 4 << 20
#: Removes the shuffle files of a query when it ends: else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; every operator of the subpackage calls it first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors share no folder")
        path = f"file://{tempfile.mkdtemp(prefix='loomstone-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes them once a later table holds the result."""

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a Parquet table: task retries and lost executors cannot change what later stages read."""
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # for this write alone, whose shuffles nothing else reads
        try:
            df.write.option("compression", "zstd").parquet(path := self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written; every other table of this scratch is removed."""
        out = self.table(df, name)
        self.drop(keep=1)
        return out

    def drop(self, keep: int = 0) -> None:
        old, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        jvm = self.spark.sparkContext._jvm
        for x in old:
            p = jvm.org.apache.hadoop.fs.Path(x)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def filled(df: DataFrame, column: str = "text") -> DataFrame:
    """A null text is an empty text."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each; a longer single row comes alone."""
    tokens.rest()
    for batch in batches:
        sizes = [0] * batch.num_rows
        lengths = pc.binary_length(batch.column(column))
        sizes = pc.fill_null(lengths, 0).to_pylist()
        at = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)
