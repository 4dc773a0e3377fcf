"""Vector search: exact top-k and its variants over ``vectors(id, embedding[, attr])``.

Single-query forms are one projection and ``TakeOrderedAndProject``: each partition keeps k rows and only those meet.
Batches of queries run as matrix products per Arrow batch with a partial top-k in every partition, so what is shuffled
is k rows per query and partition. Queries are broadcast in blocks of at most BLOCK, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import vectors as V

#: Queries in one broadcast: 4096 of 1536 dimensions take 25 MB.
BLOCK = 4096


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


def distances(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    return vectors.withColumn("dist", V.cosine_distance("embedding", literal(query)))


def topk(vectors: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest by cosine distance, the lower id first in a tie; the filter applies before the ranking."""
    rows = vectors if where is None else vectors.where(where)
    return distances(rows, query).select("id", "dist").orderBy("dist", "id").limit(k)


def radius(vectors: DataFrame, query: Sequence[float], k: int, most: float) -> DataFrame:
    rows = distances(vectors, query).select("id", "dist").where(F.col("dist") <= most)
    return rows.orderBy("dist", "id").limit(k)


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", skip_self: bool = False, keep=None) -> DataFrame:
    """``queries(qid, embedding)`` against all vectors: qid, id, dist, rank (from 1).

    ``keep(unit vectors, unit queries)`` says which vectors are candidates of which query, all where it is None.
    """
    spark, best = vectors.sparkSession, None
    block: list = []

    def scan(block: list) -> DataFrame:
        q = np.array([r["embedding"] for r in block], np.float64)
        norms = np.linalg.norm(q, axis=1, keepdims=True)
        held = spark.sparkContext.broadcast((np.array([r["qid"] for r in block], np.int64), q / np.where(norms > 0, norms, 1) if metric == "cosine" else q))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            kept_id, kept_d = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                col = batch.column("embedding")
                if not len(col):
                    continue
                v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
                if metric == "cosine":
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    v = v / np.where(n > 0, n, 1)
                    d = np.clip(1 - q @ v.T, 0, 2)
                else:
                    d = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (v**2).sum(1) - 2 * q @ v.T))
                own = np.broadcast_to(batch.column("id").to_numpy(zero_copy_only=False), d.shape)
                if skip_self:
                    d = np.where(own == ids[:, None], np.inf, d)
                if keep is not None:
                    d = np.where(keep(v, q), d, np.inf)
                kept_id, kept_d = np.concatenate([kept_id, own], 1), np.concatenate([kept_d, d], 1)
                order = np.lexsort((kept_id, np.round(kept_d, 12)), axis=1)[:, :k]
                kept_id, kept_d = np.take_along_axis(kept_id, order, 1), np.take_along_axis(kept_d, order, 1)
            who = np.repeat(ids, kept_id.shape[1])
            real = np.isfinite(kept_d.ravel())
            yield pa.record_batch([pa.array(who[real]), pa.array(kept_id.ravel()[real]), pa.array(kept_d.ravel()[real])], names=["qid", "id", "dist"])

        return vectors.select(F.col("id").cast("bigint").alias("id"), "embedding").mapInArrow(nearest, "qid bigint, id bigint, dist double")

    for r in queries.select(F.col("qid").cast("bigint").alias("qid"), "embedding").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            best = scan(block) if best is None else best.unionByName(scan(block))
            block = []
    if block or best is None:
        part = scan(block) if block else spark.createDataFrame([], "qid bigint, id bigint, dist double")
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("qid").orderBy(F.round("dist", 12), "id")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def recommend(vectors: DataFrame, liked: DataFrame, disliked: DataFrame, k: int, exclude_examples: bool = False) -> DataFrame:
    """By the best inner product with a liked example against the best with a disliked one; small example sets."""
    n = F.broadcast(liked.agg(F.collect_list(V.normalized("embedding")).alias("p")).crossJoin(disliked.agg(F.collect_list(V.normalized("embedding")).alias("n"))))
    rows = vectors.withColumn("u", V.normalized("embedding")).join(n)
    rows = rows.withColumn("bp", F.array_max(F.transform("p", lambda x: V.dot("u", x)))).withColumn("bn", F.array_max(F.transform("n", lambda x: V.dot("u", x))))
    bend = lambda x: 0.5 * (1 + x / (1 + F.abs(x)))
    score = F.when(F.col("bn").isNull() | (F.col("bp") > F.col("bn")), bend(F.col("bp"))).otherwise(-bend(F.col("bn")))
    if exclude_examples:
        rows = rows.join(liked.select("id").union(disliked.select("id")), "id", "left_anti")
    return rows.select("id", (1 - score).alias("dist")).orderBy("dist", "id").limit(k)


def mmr(vectors: DataFrame, query: Sequence[float], k: int, weight: float) -> DataFrame:
    """Maximal marginal relevance over the nearest 4k: each pick weighs nearness against likeness to earlier picks."""
    weight = min(1.0, max(0.0, weight))
    pool = distances(vectors, query).orderBy("dist", "id").limit(4 * k).select("id", "dist", V.normalized("embedding").alias("u"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["dist"], r["id"]))
        u = np.array([r["u"] for r in rows])
        chosen: list[int] = []
        while len(chosen) < min(k, len(rows)):
            rest = [i for i in range(len(rows)) if i not in chosen]
            like = u[rest] @ u[chosen].T if chosen else np.zeros((len(rest), 1))
            value = weight * (1 - np.array([rows[i]["dist"] for i in rest])) - (1 - weight) * np.maximum(0, like.max(1))
            chosen.append(rest[int(np.argmax(value))])
        yield pa.record_batch([pa.array(range(1, len(chosen) + 1), pa.int64()), pa.array([rows[i]["id"] for i in chosen], pa.int64()), pa.array([rows[i]["dist"] for i in chosen], pa.float64())], names=["pick", "id", "dist"])

    return pool.coalesce(1).mapInArrow(pick, "pick bigint, id bigint, dist double")


def postings(vectors: DataFrame) -> DataFrame:
    """(id, term, weight): the eight strongest dimensions of each vector."""
    return vectors.select("id", F.explode(V.terms("embedding")).alias("t")).select("id", "t.term", "t.weight")


def bm25(postings: DataFrame, terms: dict[int, float], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 over posting entries (a weight counts once an entry); only positive scores, equal to nine digits by id."""
    spark = postings.sparkSession
    lengths = postings.groupBy("id").agg(F.count("*").alias("len"))
    stats = F.broadcast(lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")))
    query = F.broadcast(spark.createDataFrame(list(terms.items()), "term int, qw double"))
    hits = postings.join(query, "term").groupBy("id", "term", "qw").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(df, "term").join(lengths, "id").join(stats)
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = rows.groupBy("id").agg(F.sum(F.col("qw") * idf * tf).alias("score")).where("score > 0")
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def fuse(lists: Sequence[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(id, rank)`` with ranks from 0."""
    parts = [x.select("id", (1.0 / (F.col("rank") + constant + 1)).alias("part")) for x in lists]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    return union.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """With ``rank`` from 0; for lists that a limit bounds already."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def hybrid(vectors: DataFrame, query: Sequence[float], terms: dict[int, float], k: int) -> DataFrame:
    """Dense and sparse candidates, max(50, k) of each, fused; the second value is a fusion score."""
    n = max(50, k)
    return fuse([ranked(topk(vectors, query, n), "dist", "id"), ranked(bm25(postings(vectors), terms, n), F.desc(F.round("score", 9)), "id")], k)


def filtered_join(rows: DataFrame, column: str, value: str, vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Rows by equality, joined to vectors by a numeric key, ranked by distance."""
    keys = rows.where(F.col(column) == value).select(F.expr("try_cast(pk as bigint)").alias("id")).where("id is not null")
    return topk(vectors.join(keys, "id"), query, k)


def ivf_fit(vectors: DataFrame, cells: int, sample: int = 20_000, seed: int = 7, steps: int = 10) -> np.ndarray:
    """Centroids by Lloyd's steps on a bounded sample (a parameter), chosen by hash of the id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()["embedding"]
    x = np.array([np.asarray(v, np.float64) for v in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def ivf_topk(vectors: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int, probes: int) -> DataFrame:
    """Nearest among the vectors of the ``probes`` cells nearest to the query; every vector belongs to a cell."""
    cells = F.array(*[literal(c) for c in centroids])
    near = F.transform(cells, lambda c: V.dot("embedding", c))
    q = np.asarray(query, float)
    chosen = np.argsort(-(centroids @ (q / max(np.linalg.norm(q), 1e-12))), kind="stable")[:probes].tolist()
    return topk(vectors.withColumn("cell", F.array_position(near, F.array_max(near)) - 1), query, k, F.col("cell").isin(chosen))


def calibrate(vectors: DataFrame, centroids: np.ndarray, queries: Sequence[Sequence[float]], k: int, target: float = 0.92) -> int:
    """The least number of probes whose mean recall against exact search reaches the target; all cells if none does."""
    exact = [{r["id"] for r in topk(vectors, q, k).collect()} for q in queries]
    probes = 1
    while probes < len(centroids):
        hits = [len(e & {r["id"] for r in ivf_topk(vectors, centroids, q, k, probes).collect()}) for q, e in zip(queries, exact, strict=True)]
        if sum(hits) >= target * sum(map(len, exact)):
            return probes
        probes *= 2
    return len(centroids)


def ivf_batch(vectors: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """``ivf_topk`` of each of ``queries(qid, embedding)``: qid, id, dist, rank (from 1)."""

    def keep(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        chosen = np.zeros((len(q), len(centroids)), bool)
        np.put_along_axis(chosen, np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes], True, 1)
        return chosen[:, (x @ centroids.T).argmax(1)]

    return batch_topk(vectors, queries, k, keep=keep)


def calibrate_batch(vectors: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, target: float = 0.92) -> int:
    """The least power of two of probes whose recall over all queries reaches the target, else all cells."""
    exact = batch_topk(vectors, queries, k).select("qid", "id").cache()
    total, probes = exact.count(), 1
    while probes < len(centroids) and ivf_batch(vectors, centroids, queries, k, probes).join(exact, ["qid", "id"]).count() < target * total:
        probes *= 2
    exact.unpersist()
    return min(probes, len(centroids))
