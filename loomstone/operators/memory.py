"""Agent memory: long-term recall now and as of a time, retrieval lists and context, graph, working memory, episodes.

``ltm(id, text, embedding, source, salience, owner, valid_from, valid_to)``; times are whole numbers, 0 means open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions import vectors as V
from loomstone.sources import scratch

from . import vector


def valid_at(t: int) -> Column:
    """Half-open validity, 0 for an open end."""
    return ((F.col("valid_from") == 0) | (F.col("valid_from") <= t)) & ((F.col("valid_to") == 0) | (F.col("valid_to") > t))


def visible(ltm: DataFrame, scope: str, t: int) -> DataFrame:
    return ltm.where(F.col("owner").isin(scope, "") & valid_at(t))


def _query_tokens(spark, query: str) -> DataFrame:
    return spark.sql("select 1").select(F.explode(T.tokens(F.lit(query))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))


def recall(ltm: DataFrame, scope: str, query: str, embedding: Sequence[float], k: int, t: int, pool: int | None = None) -> DataFrame:
    """Blend of semantic and keyword evidence: id, score, kind. Document frequencies count every owner and time."""
    spark, fetch = ltm.sparkSession, 3 * (pool or k)
    boost = 0.5 + 0.5 * F.col("salience")
    seen = visible(ltm, scope, t)
    near = seen.withColumn("cos", 1 - V.cosine_distance("embedding", vector.literal(embedding))).where("cos > 0")
    semantic = near.orderBy(F.desc("cos"), "id").limit(fetch).select("id", ((1 + F.col("cos")) / 2 * boost).alias("semantic"))
    asked = F.broadcast(_query_tokens(spark, query))
    words = ltm.select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).join(asked, "token")
    df = F.broadcast(words.groupBy("token").agg(F.count("*").alias("df")))
    n = F.broadcast(ltm.agg(F.count("*").alias("n")))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0)) + 1
    found = words.join(df, "token").join(n).join(seen.select("id", "salience"), "id")
    keyword = found.groupBy("id").agg(F.sum(idf * 0.8 * boost * F.col("times")).alias("keyword"))
    both = semantic.join(keyword, "id", "full_outer")
    score = F.coalesce("semantic", F.lit(0.0)) + F.coalesce("keyword", F.lit(0.0))
    kind = F.when(F.col("semantic").isNotNull(), "semantic").otherwise("keyword")
    return both.select("id", score.alias("score"), kind.alias("kind")).orderBy(F.desc("score"), "id").limit(pool or k)


def retrieve(ltm: DataFrame, scope: str, query: str, embedding: Sequence[float], k: int, t: int) -> DataFrame:
    """Retrieval order: reciprocal rank within the hit's own list plus 0.01 for each query token it holds.

    Columns: pos (from 1), id, score (the recall evidence), source, text.
    """
    hits = recall(ltm, scope, query, embedding, k, t, pool=max(4 * k, 20))
    own = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("part", 1.0 / (60 + F.row_number().over(own)))
    full = hits.join(ltm.select("id", "source", "text"), "id")
    asked = T.tokens(F.lit(query))
    held = T.tokens(F.col("text"))
    overlap = F.size(F.filter(asked, lambda x: F.array_contains(held, x)))
    full = full.withColumn("rank", F.col("part") + 0.01 * overlap).orderBy(F.desc("rank"), "id").limit(k)
    return full.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rank"), "id")).cast("bigint")).select("pos", "id", "score", "source", "text")


def context(hits: DataFrame) -> DataFrame:
    """One row: ``[i] (source) text`` lines of retrieved hits in order."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] ("), "source", F.lit(") "), "text", F.lit("\n"))
    rows = hits.agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r.line), "").alias("context"))


def consolidate(ltm: DataFrame, changes: DataFrame) -> DataFrame:
    """Salience moved by ``changes(id, delta)``, kept within 0 and 1."""
    delta = changes.groupBy("id").agg(F.sum("delta").alias("delta"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("salience") + F.coalesce("delta", F.lit(0.0))))
    return ltm.join(delta, "id", "left").withColumn("salience", moved).drop("delta")


def invalidate(ltm: DataFrame, events: DataFrame) -> DataFrame:
    """``events(id, owner, at)`` end the validity of facts that their owner holds; the last one counts."""
    last = events.groupBy("id", "owner").agg(F.max("at").alias("at"))
    return ltm.join(last, ["id", "owner"], "left").withColumn("valid_to", F.coalesce("at", "valid_to")).drop("at")


def forget(ltm: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(id, owner)`` delete; a null owner may delete any."""
    asked = requests.select("id", F.col("owner").alias("by"))
    return ltm.join(asked, (ltm["id"] == asked["id"]) & (asked["by"].isNull() | (asked["by"] == ltm["owner"])), "left_anti")


def neighbours(edges: DataFrame, node: str, relation: str | None = None, incoming: bool = False) -> DataFrame:
    """Edges of a node, latest weight each, by relation and other end."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    rows = edges.where(F.col(here) == node)
    rows = rows if relation is None else rows.where(F.col("rel") == relation)
    return rows.select(F.col(there).alias("id"), "rel", "weight").orderBy("rel", "id")


def traverse(edges: DataFrame, start: str, depth: int, relation: str | None = None) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps, each at its least depth; one join a step, whose result is written so that no plan grows."""
    rows = edges if relation is None else edges.where(F.col("rel") == relation)
    rows = rows.select("src", "dst").distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(rows, frontier["id"] == rows["src"]).select(F.col("dst").alias("id")).distinct()
        step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)).write.parquet(path := scratch.folder(edges.sparkSession, "frontier"))
        frontier = edges.sparkSession.read.schema("id string, depth int").parquet(path)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def working(items: DataFrame, agent: str, now: int) -> DataFrame:
    """Live keys of an agent's working memory ``(agent, key, value, seq, expires_at)``; expired from ``expires_at`` on."""
    last = items.where(F.col("agent") == agent).groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), "seq").alias("v"))
    return last.select("key", "v.value", "v.expires_at").where(F.col("expires_at").isNull() | (F.col("expires_at") == 0) | (F.col("expires_at") > now))


def episodes(rows: DataFrame, agent: int, limit: int) -> DataFrame:
    """The oldest ``limit`` episodes of an agent in order."""
    return rows.where(F.col("agent") == agent).orderBy("seq").limit(limit)


def procedures(rows: DataFrame, agent: str) -> DataFrame:
    """Named blobs of an agent, the last of each name, by name."""
    return rows.where(F.col("agent") == agent).groupBy("name").agg(F.max_by("body", "seq").alias("body")).orderBy("name")
