"""The logical models read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("attr"))


def query_vector(spark: SparkSession, d: str, ident: int = 0) -> list[float]:
    """The embedding of one id, looked up."""
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == ident).first()["embedding"])


def ltm(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an embedding: salience from the quality label, owner from the source, validity from the id."""
    docs, emb, lab = (table(spark, d, t) for t in ("documents", "embeddings", "labels"))
    rows = docs.join(emb.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").join(lab.select("doc_id", "quality"), "doc_id", "left")
    owner = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.when(F.col("doc_id") % 5 < 3, "alice").otherwise("bob"))
    return rows.select(
        F.col("doc_id").alias("id"), "text", "embedding", "source", F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).otherwise(0.5).alias("salience"), owner.alias("owner"),
        (F.col("doc_id") % 7 * 100).alias("valid_from"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 * 100 + 400).otherwise(F.lit(0)).alias("valid_to"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("series"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), "value")


def zset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("id_ms"), F.col("event_id").alias("id_seq"), "user_id", "value")


def mutations(spark: SparkSession, d: str) -> DataFrame:
    """Order prices as versions of their customer's key; cancelled-looking statuses delete."""
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("cust:"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("key"), F.col("o_orderkey").alias("ts"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "P").alias("is_deleted"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """region -has-> nation -has-> customer -placed-> order."""
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return (
        n.select(name("r", "n_regionkey").alias("src"), F.lit("has").alias("rel"), name("n", "n_nationkey").alias("dst"), F.lit(1.0).alias("weight"))
        .unionByName(c.select(name("n", "c_nationkey").alias("src"), F.lit("has").alias("rel"), name("c", "c_custkey").alias("dst"), F.lit(0.5).alias("weight")))
        .unionByName(o.select(name("c", "o_custkey").alias("src"), F.lit("placed").alias("rel"), name("o", "o_orderkey").alias("dst"), F.col("o_totalprice").alias("weight")))
    )
