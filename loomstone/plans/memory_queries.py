"""Agent-memory, graph and retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import memory

from .tables import edges, ltm, query_vector, table

R6 = lambda c: F.round(c, 6).alias(c)
QUERY = "the thnd onand with inthe thion thnd ering"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
LTM = "ltm AS (SELECT doc_id AS id, text, embedding::DOUBLE[] AS e, source, CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.2 ELSE 0.5 END::DOUBLE AS salience, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 < 3 THEN 'alice' ELSE 'bob' END AS owner, doc_id % 7 * 100 AS valid_from, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 * 100 + 400 ELSE 0 END AS valid_to FROM documents JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id))"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 3 AND x NOT IN ({STOP}))"


def recall_sql(t: int, k: int, pool: int) -> str:
    return (
        f"WITH {LTM}, seen AS (SELECT * FROM ltm WHERE owner IN ('alice', '') AND (valid_from = 0 OR valid_from <= {t}) AND (valid_to = 0 OR valid_to > {t})), "
        "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), c AS (SELECT id, salience, list_cosine_similarity(e, q.q) AS cos FROM seen, q), "
        f"sem AS (SELECT id, (1 + cos) / 2 * (0.5 + 0.5 * salience) AS semantic FROM c WHERE cos > 0 ORDER BY cos DESC, id LIMIT {3 * pool}), "
        f"asked AS (SELECT token, count(*) AS times FROM (SELECT unnest({_tokens(repr(QUERY))}) AS token) GROUP BY token), "
        f"w AS (SELECT DISTINCT id, token FROM (SELECT id, unnest({_tokens('text')}) AS token FROM ltm) JOIN asked USING (token)), df AS (SELECT token, count(*) AS df FROM w GROUP BY token), n AS (SELECT count(*) AS n FROM ltm), "
        "kw AS (SELECT w.id, sum((greatest(ln((n - df + 0.5) / (df + 0.5)), 0.0) + 1) * 0.8 * (0.5 + 0.5 * salience) * times) AS keyword FROM w JOIN df USING (token) JOIN asked USING (token) JOIN seen ON seen.id = w.id, n GROUP BY w.id), "
        f"hits AS (SELECT coalesce(sem.id, kw.id) AS id, coalesce(semantic, 0.0) + coalesce(keyword, 0.0) AS score, CASE WHEN semantic IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS kind FROM sem FULL JOIN kw ON sem.id = kw.id ORDER BY score DESC, id LIMIT {k})"
    )


def retrieve_sql(k: int) -> str:
    pool = max(4 * k, 20)
    return recall_sql(500, pool, pool) + (
        f", p AS (SELECT h.*, source, text, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY kind ORDER BY score DESC, h.id)) + 0.01::DOUBLE * len(list_filter({_tokens(repr(QUERY))}, lambda y: list_contains({_tokens('text')}, y))) AS rank FROM hits h JOIN ltm ON ltm.id = h.id), "
        f"f AS (SELECT row_number() OVER (ORDER BY rank DESC, id) AS pos, id, score, source, text FROM p ORDER BY rank DESC, id LIMIT {k})"
    )


def recall_now(s, d):
    return memory.recall(ltm(s, d), "alice", QUERY, query_vector(s, d), 10, 2**40).select("id", R6("score"), "kind")


def recall_as_of(s, d):
    return memory.recall(ltm(s, d), "alice", QUERY, query_vector(s, d), 10, 500).select("id", R6("score"), "kind")


def _retrieved(s, d):
    return memory.retrieve(ltm(s, d), "alice", QUERY, query_vector(s, d), 5, 500)


def retrieve(s, d):
    return _retrieved(s, d).select("pos", "id", R6("score"), "source")


def context(s, d):
    return memory.context(_retrieved(s, d))


def token_counts(s, d):
    rows = table(s, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"))


def consolidated(s, d):
    base = ltm(s, d).select("id", "salience")
    changes = table(s, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 0.3 - F.col("toxic") * 0.8).alias("delta"))
    return memory.consolidate(base, changes).select("id", R6("salience"))


def invalidated(s, d):
    base = ltm(s, d).select("id", "owner", "valid_from", "valid_to")
    events = base.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.lit("alice")).otherwise(F.lit("bob")).alias("owner"), (F.col("id") + 1000).alias("at"))
    return memory.invalidate(base, events).groupBy("owner").agg(F.count("*").alias("n"), F.sum("valid_to").alias("ends"))


def forgotten(s, d):
    base = ltm(s, d).select("id", "owner")
    asked = base.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.lit("alice")).alias("owner"))
    return memory.forget(base, asked).groupBy("owner").agg(F.count("*").alias("n"))


def neighbours(s, d):
    return memory.neighbours(edges(s, d), "c1").select("id", "rel", R6("weight"))


def incoming(s, d):
    return memory.neighbours(edges(s, d), "n3", incoming=True).select("id", "rel", R6("weight"))


def traverse(s, d):
    return memory.traverse(edges(s, d), "r1", 3).select("id", F.col("depth").cast("bigint").alias("depth"))


def traverse_relation(s, d):
    return memory.traverse(edges(s, d), "r1", 3, "has").select("id", F.col("depth").cast("bigint").alias("depth"))


def _episodes(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("agent"), F.col("turn").alias("seq"), F.col("role").alias("kind"), F.col("text").alias("payload"))


def episodes(s, d):
    return memory.episodes(_episodes(s, d), 7, 4)


def working(s, d):
    items = table(s, d, "events").select(F.col("event_type").alias("agent"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("value"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 500).otherwise(F.lit(0)).alias("expires_at"))
    return memory.working(items, "click", 9000).select("key", R6("value"))


def procedures(s, d):
    rows = table(s, d, "part").select(F.col("p_brand").alias("agent"), F.col("p_type").alias("name"), F.col("p_name").alias("body"), F.col("p_partkey").alias("seq"))
    return memory.procedures(rows, "Brand#12")


BFS = "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'has' AS rel, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'has', 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'placed', 'o' || o_orderkey FROM orders), b(id, depth) AS (SELECT 'r1', 0 UNION SELECT dst, depth + 1 FROM b JOIN e ON src = id WHERE depth < 3 {w}) SELECT id, min(depth)::BIGINT AS depth FROM b GROUP BY id"
QUERIES = {
    "memory_recall_now": (recall_now, recall_sql(2**40, 10, 10) + " SELECT id, round(score, 6) AS score, kind FROM hits"),
    "memory_recall_as_of": (recall_as_of, recall_sql(500, 10, 10) + " SELECT id, round(score, 6) AS score, kind FROM hits"),
    "retrieval_search": (retrieve, retrieve_sql(5) + " SELECT pos, id, round(score, 6) AS score, source FROM f"),
    "retrieval_context": (context, retrieve_sql(5) + " SELECT string_agg('[' || pos || '] (' || source || ') ' || text || chr(10), '' ORDER BY pos) AS context FROM f"),
    "search_tokens": (token_counts, f"SELECT doc_id, count(*) AS n, count(DISTINCT token) AS n_distinct FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY doc_id"),
    "memory_consolidate": (consolidated, f"WITH {LTM} SELECT id, round(greatest(0.0, least(1.0, salience + coalesce(quality * 0.3 - toxic * 0.8, 0.0))), 6)::DOUBLE AS salience FROM ltm LEFT JOIN labels ON doc_id = id"),
    "memory_invalidate": (invalidated, f"WITH {LTM} SELECT owner, count(*) AS n, sum(CASE WHEN id % 8 = 0 AND owner = 'alice' OR id % 8 = 4 AND owner = 'bob' THEN id + 1000 ELSE valid_to END)::BIGINT AS ends FROM ltm GROUP BY owner"),
    "memory_forget": (forgotten, f"WITH {LTM} SELECT owner, count(*) AS n FROM ltm WHERE NOT (id % 3 = 0 AND (id % 2 = 1 OR owner = 'alice')) GROUP BY owner"),
    "graph_neighbours": (neighbours, "SELECT 'o' || o_orderkey AS id, 'placed' AS rel, round(o_totalprice, 6) AS weight FROM orders WHERE o_custkey = 1"),
    "graph_incoming": (incoming, "SELECT 'r' || n_regionkey AS id, 'has' AS rel, 1.0::DOUBLE AS weight FROM nation WHERE n_nationkey = 3"),
    "graph_traverse": (traverse, BFS.format(w="")),
    "graph_traverse_relation": (traverse_relation, BFS.format(w="AND rel = 'has'")),
    "episodes": (episodes, "SELECT conv_id AS agent, turn AS seq, role AS kind, text AS payload FROM conversations WHERE conv_id = 7 ORDER BY turn LIMIT 4"),
    "working_memory": (working, "WITH r AS (SELECT 'u' || user_id AS key, value, CASE WHEN event_id % 2 = 0 THEN event_id + 500 ELSE 0 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'click') SELECT key, round(value, 6) AS value FROM r WHERE n = 1 AND (x = 0 OR x > 9000)"),
    "procedures": (procedures, "SELECT p_type AS name, arg_max(p_name, p_partkey) AS body FROM part WHERE p_brand = 'Brand#12' GROUP BY p_type"),
}
