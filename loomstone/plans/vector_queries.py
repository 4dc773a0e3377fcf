"""Vector queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import payload
from loomstone.functions import vectors as V
from loomstone.operators import quantize, vector

from .tables import query_vector, table, vectors

R6 = lambda c: F.round(c, 6).alias(c)
#: DuckDB: cosine distance to vector 0 of every vector.
DIST = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e, greatest(0.0, least(2.0, 1 - list_cosine_similarity(embedding::DOUBLE[], q.q))) AS dist FROM embeddings, q)"
#: The eight strongest dimensions of every vector.
TERMS = "u AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS term FROM embeddings), t AS (SELECT id, term::INTEGER AS term, abs(x) AS weight, row_number() OVER (PARTITION BY id ORDER BY abs(x) DESC, term) AS r FROM u), p AS (SELECT id, term, weight FROM t WHERE r <= 8)"
QUERY_TERMS = {3: 1.0, 10: 0.5, 20: 2.0, 40: 1.5}
QT = "qt(term, qw) AS (VALUES (3, 1.0::DOUBLE), (10, 0.5), (20, 2.0), (40, 1.5))"
BM25 = "len AS (SELECT id, count(*) AS len FROM p GROUP BY id), st AS (SELECT count(*) AS n, avg(len) AS a FROM len), hit AS (SELECT p.id, p.term, qt.qw, count(*) AS tf FROM p JOIN qt ON p.term = qt.term GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term), bm AS (SELECT hit.id, sum(qw * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score FROM hit JOIN df USING (term) JOIN len USING (id), st GROUP BY hit.id HAVING score > 0)"
FILTER = {"must": [{"key": "k", "range": {"gte": 10, "lt": 60}}], "should": [{"key": "k", "match": {"any": [11, 12, 13, 20, 21, 22, 23, 24, 25, 30, 40, 50]}}, {"has_id": list(range(50))}], "must_not": [{"key": "k", "match": {"value": 22}}]}


def topk(s, d):
    return vector.topk(vectors(s, d), query_vector(s, d), 10).select("id", R6("dist"))


def filtered_topk(s, d):
    return vector.topk(vectors(s, d), query_vector(s, d), 10, F.col("attr") == 3).select("id", R6("dist"))


def filtered_in(s, d):
    return vector.topk(vectors(s, d), query_vector(s, d), 10, F.col("attr").isin(1, 4, 7)).select("id", R6("dist"))


def radius(s, d):
    return vector.radius(vectors(s, d), query_vector(s, d), 50, 0.9).select("id", R6("dist"))


def batch(s, d):
    v = vectors(s, d)
    return vector.batch_topk(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 5).select("qid", "id", R6("dist"), "rank")


def knn(s, d):
    v = vectors(s, d)
    return vector.batch_topk(v, v.withColumnRenamed("id", "qid"), 3, metric="l2", skip_self=True).select("qid", "id", R6("dist"), "rank")


def recommend(s, d):
    v = vectors(s, d)
    return vector.recommend(v, v.where("id in (1, 2, 3)"), v.where("id in (7, 8)"), 10).select("id", R6("dist"))


def mmr(s, d):
    return vector.mmr(vectors(s, d), query_vector(s, d), 10, 0.6).select("pick", "id", R6("dist"))


def derived_attr(s, d):
    return vectors(s, d).select("id", V.category("embedding").cast("bigint").alias("category"))


def sparse_terms(s, d):
    return vector.postings(vectors(s, d)).select("id", "term", R6("weight"))


def sparse_bm25(s, d):
    return vector.bm25(vector.postings(vectors(s, d)), QUERY_TERMS, 20).select("id", R6("score"))


def hybrid(s, d):
    return vector.hybrid(vectors(s, d), query_vector(s, d), QUERY_TERMS, 10).select("id", R6("score"))


def namespaces(s, d):
    return vectors(s, d).groupBy(F.col("attr").cast("string").alias("ns")).agg(F.count("*").alias("n"))


def int8(s, d):
    codes = V.quantize_int8(V.normalized("embedding"))
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x.cast("bigint"))
    return vectors(s, d).select("id", total.alias("energy"), F.array_max(codes).cast("bigint").alias("top"))


def binary(s, d):
    q = vector.literal(query_vector(s, d))
    return vectors(s, d).select("id", F.round(V.agreement("embedding", q), 6).alias("agreement")).orderBy(F.desc("agreement"), "id").limit(10)


def payload_topk(s, d):
    events = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("doc"))
    rows = vectors(s, d).join(events.where(payload.compile_filter(FILTER, F.col("doc"), F.col("id"))), "id")
    return vector.topk(rows, query_vector(s, d), 10).select("id", R6("dist"))


def facet(s, d):
    events = table(s, d, "events").select(F.explode(payload.labels(F.col("props"), "k")).alias("value"))
    return events.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10)


def join_topk(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("pk"), "c_mktsegment")
    return vector.filtered_join(rows, "c_mktsegment", "BUILDING", vectors(s, d), query_vector(s, d), 10).select("id", R6("dist"))


def fused_lists(s, d):
    v, q = vectors(s, d), query_vector(s, d)
    lists = [vector.ranked(vector.topk(v, x, 50), "dist", "id") for x in (q, query_vector(s, d, 1))]
    return vector.fuse(lists, 10).select("id", R6("score"))


def hundredth(v):
    return v.where("id % 100 = 0").withColumnRenamed("id", "qid")


def ivf(s, d):
    v = vectors(s, d)
    cells, queries = vector.ivf_fit(v, 16), hundredth(v)
    return vector.ivf_batch(v, cells, queries, 10, vector.calibrate_batch(v, cells, queries, 10)).select("qid", "id", R6("dist"), "rank")


def product_codes(s, d):
    v = vectors(s, d)
    return quantize.coded_batch(v, hundredth(v), 10, quantize.Product.fit(quantize.sampled(v, 5000))).select("qid", "id", R6("dist"), "rank")


def rotated_codes(s, d):
    v = vectors(s, d)
    return quantize.coded_batch(v, hundredth(v), 10, quantize.Rotated.fit(quantize.sampled(v, 5000))).select("qid", "id", R6("dist"), "rank")


def entropy(s, d):
    return vectors(s, d).select("id", F.round(V.softmax_entropy("embedding"), 6).alias("entropy"))


def selectivity(s, d):
    v = vectors(s, d)
    return v.groupBy(F.col("attr").cast("bigint").alias("attr")).agg(F.count("*").alias("n")).join(F.broadcast(v.agg(F.count("*").alias("all"))), how="cross").select("attr", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


TOP = " SELECT id, round(dist, 6) AS dist FROM d {where} ORDER BY d.dist, id LIMIT {k}"
QUERIES = {
    "vector_topk": (topk, DIST + TOP.format(where="", k=10)),
    "vector_filtered_topk": (filtered_topk, DIST + TOP.format(where="WHERE label = 3", k=10)),
    "vector_filtered_in": (filtered_in, DIST + TOP.format(where="WHERE label IN (1, 4, 7)", k=10)),
    "vector_radius": (radius, DIST + TOP.format(where="WHERE d.dist <= 0.9", k=50)),
    "vector_batch_topk": (batch, "WITH x AS (SELECT a.vec_id AS qid, b.vec_id AS id, greatest(0.0, least(2.0, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 12), id) AS rank FROM x) SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 5"),
    "vector_knn_graph": (knn, "WITH x AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 12), id) AS rank FROM x) SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 3"),
    "vector_recommend": (recommend, "WITH s AS (SELECT v.vec_id AS id, max(CASE WHEN e.vec_id < 5 THEN list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) END) AS bp, max(CASE WHEN e.vec_id > 5 THEN list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) END) AS bn FROM embeddings v, embeddings e WHERE e.vec_id IN (1, 2, 3, 7, 8) GROUP BY v.vec_id), x AS (SELECT id, 1 - CASE WHEN bp > bn THEN 0.5 * (1 + bp / (1 + abs(bp))) ELSE -0.5 * (1 + bn / (1 + abs(bn))) END AS dist FROM s) SELECT id, round(dist, 6) AS dist FROM x ORDER BY x.dist, id LIMIT 10"),
    "vector_mmr": (mmr, None),
    "vector_derived_attr": (derived_attr, "WITH u AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), r AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY abs(x) DESC, i) AS n FROM u) SELECT id, (i % 8)::BIGINT AS category FROM r WHERE n = 1"),
    "vector_sparse_terms": (sparse_terms, f"WITH {TERMS} SELECT id, term, round(weight, 6) AS weight FROM p"),
    "vector_sparse_bm25": (sparse_bm25, f"WITH {TERMS}, {QT}, {BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, id LIMIT 20"),
    "vector_hybrid": (hybrid, DIST + f", {TERMS}, {QT}, {BM25}, a AS (SELECT id, row_number() OVER (ORDER BY dist, id) - 1 AS r FROM d), b AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS r FROM bm), f AS (SELECT id, sum(1.0::DOUBLE / (r + 61)) AS score FROM (SELECT * FROM a WHERE r < 50 UNION ALL SELECT * FROM b WHERE r < 50) GROUP BY id) SELECT id, round(score, 6) AS score FROM f ORDER BY round(f.score, 12) DESC, id LIMIT 10"),
    "vector_namespaces": (namespaces, "SELECT label::VARCHAR AS ns, count(*) AS n FROM embeddings GROUP BY 1"),
    "vector_int8": (int8, "WITH u AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), c AS (SELECT id, round(x / n * 127)::BIGINT AS c FROM u) SELECT id, sum(c * c)::BIGINT AS energy, max(c) AS top FROM c GROUP BY id"),
    "vector_binary": (binary, "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), u AS (SELECT vec_id AS id, unnest(embedding) AS x, unnest(q.q) AS y FROM embeddings, q), a AS (SELECT id, avg(CASE WHEN (x >= 0) = (y >= 0) THEN 1.0::DOUBLE ELSE 0 END) AS a FROM u GROUP BY id) SELECT id, round(a, 6) AS agreement FROM a ORDER BY a.a DESC, id LIMIT 10"),
    "vector_payload_filter": (payload_topk, DIST + ", e AS (SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events) SELECT d.id, round(dist, 6) AS dist FROM d JOIN e ON e.event_id = d.id WHERE k >= 10 AND k < 60 AND (k IN (11, 12, 13, 20, 21, 22, 23, 24, 25, 30, 40, 50) OR d.id < 50) AND k <> 22 ORDER BY d.dist, d.id LIMIT 10"),
    "payload_facet": (facet, "SELECT props->>'$.k' AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 10"),
    "row_vector_join_topk": (join_topk, DIST + ' SELECT d.id, round(dist, 6) AS dist FROM d JOIN customer c ON c.c_custkey = d.id WHERE c.c_mktsegment = \'BUILDING\' ORDER BY d.dist, d.id LIMIT 10'),
    "rank_fusion": (fused_lists, "WITH x AS (SELECT a.vec_id AS q, b.vec_id AS id, greatest(0.0, least(2.0, 1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]))) AS dist FROM embeddings a, embeddings b WHERE a.vec_id IN (0, 1)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) - 1 AS r FROM x), f AS (SELECT id, sum(1.0::DOUBLE / (r + 61)) AS score FROM r WHERE r < 50 GROUP BY id) SELECT id, round(score, 6) AS score FROM f ORDER BY round(f.score, 12) DESC, id LIMIT 10"),
    "vector_ivf": (ivf, None),
    "vector_product_codes": (product_codes, None),
    "vector_rotated_codes": (rotated_codes, None),
    "vector_softmax_entropy": (entropy, "WITH u AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT id, exp(x) AS e FROM u), z AS (SELECT id, sum(e) AS z FROM e GROUP BY id) SELECT id, round(sum(-e / z * ln(e / z)), 6) AS entropy FROM e JOIN z USING (id) GROUP BY id"),
    "attr_selectivity": (selectivity, "SELECT label::BIGINT AS attr, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM embeddings), 6) AS share FROM embeddings GROUP BY label"),
}
