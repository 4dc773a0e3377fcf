"""Queries over keyed collections and time series, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import keyspace as K
from loomstone.operators import timeseries

from .tables import points, table, zset

R6 = lambda c: F.round(c, 6).alias(c)
BIG = lambda c: F.col(c).cast("bigint").alias(c)


def _log(s, d):
    """One command per event: key = type, sequence = id."""
    return table(s, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("user_id"), "value", "props")


def kv_set(s, d):
    return K.last_value(_log(s, d), ["key"], "props").select("key", "props")


def kv_setnx(s, d):
    return K.first_value(_log(s, d), ["key"], "props").select("key", "props")


def kv_getset(s, d):
    return K.previous_value(_log(s, d), ["key"], "user_id").select("key", "seq", "previous")


def kv_incr(s, d):
    return K.running_sum(_log(s, d), ["key"], "user_id").select("key", "seq", "reply")


def kv_append(s, d):
    pieces = _log(s, d).select("key", "seq", F.col("user_id").cast("string").alias("value"))
    return K.appended(pieces).select("key", F.md5("value").alias("digest"), "bytes")


def kv_ranges(s, d):
    c = F.col("c_name")
    return table(s, d, "customer").select("c_custkey", K.byte_range(c, 0, 7).alias("head"), K.byte_range(c, -5, -1).alias("tail"), K.set_range(c, 2, "XY").cast("string").alias("patched"), F.octet_length(c).cast("bigint").alias("bytes"))


def kv_fold(s, d):
    """Mixed string commands in order, by the sequential fold."""
    cmds = F.array(*[F.lit(x) for x in ("SET", "APPEND", "GET", "SETNX", "GETDEL", "DEL")])
    log = _log(s, d).select(F.concat("key", F.lit(":"), F.col("user_id").cast("string")).alias("key"), "seq", F.get(cmds, F.pmod("seq", F.lit(6)).cast("int")).alias("cmd"), F.col("seq").cast("string").alias("value"))
    return K.fold(log, K.string_step)


def kv_ttl(s, d):
    rows = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("expire_at"))
    return rows.select("event_id", K.ttl_seconds(F.col("expire_at"), 1705000000000).alias("ttl"))


def kv_expire_flags(s, d):
    rows = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id") * 10).alias("old"), F.col("event_id").alias("new"))
    flags = [F.sum(K.expire_allowed(F.col("old"), F.col("new"), f).cast("bigint")).alias(f.lower()) for f in ("NX", "XX", "GT", "LT")]
    return rows.agg(*flags)


def kv_exists(s, d):
    asked = table(s, d, "orders").select(F.col("o_custkey").alias("key"))
    return K.exists_count(asked, table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")))


def kv_live(s, d):
    rows = table(s, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("expire_at"))
    return K.live(rows, 1705000000000).groupBy("event_type").agg(F.count("*").alias("n"))


def keys_glob(s, d):
    return table(s, d, "customer").where(T.glob_match(F.col("c_name"), "Customer#*[0-4]?7")).select("c_custkey", "c_name")


def keys_prefix(s, d):
    return table(s, d, "part").where(T.keys_match(F.col("p_brand"), "Brand#1")).groupBy("p_brand").agg(F.count("*").alias("n"))


def _hash(s, d):
    c = table(s, d, "customer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("c_name", "c_mktsegment", "c_nationkey")])
    return c.select(F.col("c_custkey").alias("key"), F.explode(pairs).alias("p")).select("key", "p.field", "p.value")


def hash_all(s, d):
    rows = _hash(s, d).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("m"))
    return rows.select("key", F.array_join(F.map_keys("m"), ",").alias("fields"), F.element_at("m", "c_mktsegment").alias("segment"), F.size("m").cast("bigint").alias("n"), F.map_contains_key("m", "nope").alias("has_nope"))


def hash_set(s, d):
    rows = _log(s, d).select("key", F.col("user_id").alias("field"), "seq", "value")
    return K.last_value(rows, ["key", "field"]).select("key", "field", R6("value"))


def hash_incr(s, d):
    return _log(s, d).groupBy("key", F.col("user_id").alias("field")).agg(F.sum("value").alias("total")).select("key", "field", R6("total"))


def hash_delete(s, d):
    gone = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")).distinct().withColumn("field", F.lit("c_name"))
    return _hash(s, d).join(gone, ["key", "field"], "left_anti").groupBy("field").agg(F.count("*").alias("n"))


def _list(s, d):
    return K.list_positions(table(s, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "L").otherwise("R").alias("side"), F.col("user_id").alias("value")))


LISTS = "l AS (SELECT event_type AS key, user_id AS value, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 3 = 0 THEN -event_id ELSE event_id END) - 1 AS pos FROM events)"


def list_range(s, d):
    return K.list_range(_list(s, d), -20, -3).select("key", BIG("pos"), "value")


def list_remove(s, d):
    return K.list_remove(_list(s, d), F.lit(5), 2).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("pos") * F.col("value")).alias("mark"))


def list_find(s, d):
    return K.list_find(_list(s, d), F.lit(7), rank=-2, count=3).select("key", BIG("pos"))


def list_trim(s, d):
    return K.list_range(_list(s, d), 10, 19).select("key", (F.col("pos") - 10).cast("bigint").alias("pos"), "value")


def list_set(s, d):
    return K.list_set(_list(s, d), -2, F.lit(-1)).where("value = -1").select("key", BIG("pos"))


def list_insert(s, d):
    return K.list_insert(_list(s, d), F.lit(7), F.lit(-5).cast("bigint")).where("value = -5").select("key", BIG("pos"))


def list_move(s, d):
    return K.list_move(_list(s, d), "click", "error", True, False).groupBy("key").agg(F.count("*").alias("n"), F.max_by("value", "pos").alias("tail"))


def key_rename(s, d):
    view = table(s, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value"))
    first = view.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    return K.rename(view, first["a"], first["b"]).select("key", BIG("value"))


def key_types(s, d):
    rows = K.types({"zset": zset(s, d), "set": _sets(s, d), "string": table(s, d, "nation").select(F.col("n_name").alias("key"))})
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def kv_msetnx(s, d):
    current = table(s, d, "nation").select(F.col("n_name").alias("key"))
    batch = table(s, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("value"))
    return K.set_if_none_exist(current, batch)


def set_random(s, d):
    return K.random_members(_sets(s, d).distinct(), 3, seed=5)


def list_fold(s, d):
    cmds = F.array(*[F.lit(x) for x in ("RPUSH", "LPUSH", "RPUSH", "LPOP", "LLEN", "RPOP")])
    log = _log(s, d).select("key", "seq", F.get(cmds, F.pmod("seq", F.lit(6)).cast("int")).alias("cmd"), F.col("user_id").cast("string").alias("value"))
    return K.fold(log, K.list_step)


def _sets(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"))


def set_union(s, d):
    return K.set_algebra(_sets(s, d), "union", ["click", "error"])


def set_inter(s, d):
    return K.set_algebra(_sets(s, d), "inter", ["click", "error", "signup"])


def set_diff(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()
    return K.set_algebra(orders, "diff", ["F", "P", "nope"])


def set_members(s, d):
    log = _log(s, d).select("key", F.col("user_id").cast("string").alias("member"), F.when(F.col("seq") % 4 == 0, "rem").otherwise("add").alias("op"), "seq")
    return K.members(log)


def set_cardinality(s, d):
    return _sets(s, d).distinct().groupBy("key").agg(F.count("*").alias("n"), F.max((F.col("member") == "7").cast("int")).cast("bigint").alias("has_7"))


def set_move(s, d):
    rows = _sets(s, d).distinct()
    moved = rows.withColumn("key", F.when((F.col("key") == "error") & (F.col("member") < "3"), "click").otherwise(F.col("key"))).distinct()
    return moved.groupBy("key").agg(F.count("*").alias("n"))


def zset_rank(s, d):
    return K.zranked(zset(s, d)).select("key", "member", R6("score"), "rank", "revrank")


def zset_range(s, d):
    return K.zrange(zset(s, d), -10, -2, rev=True).select("key", "member", R6("score"), "rank")


def zset_by_score(s, d):
    return K.zrange_by_score(zset(s, d), "(100", "5000.5", 3, 7, rev=True).select("key", "member", R6("score"))


def zset_by_lex(s, d):
    m = F.col("member")
    rows = zset(s, d).where(K.lex_bound(m, "[Customer#000000010", True) & K.lex_bound(m, "(Customer#000000050", False))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("member").alias("first"), F.max("member").alias("last"))


def zset_count(s, d):
    c = F.col("score")
    return zset(s, d).groupBy("key").agg(F.count("*").alias("card"), F.sum((K.bound(c, "0", True) & K.bound(c, "+inf", False)).cast("bigint")).alias("n"))


def zset_pop(s, d):
    popped, left = K.zpop(zset(s, d), 3)
    a = popped.groupBy("key").agg(F.max("score").alias("last_popped"), F.count("*").alias("popped"))
    return a.join(left.groupBy("key").agg(F.min("score").alias("least_left"), F.count("*").alias("left")), "key").select("key", R6("last_popped"), "popped", R6("least_left"), "left")


def _zlog(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))


def zset_add(s, d):
    rows = _zlog(s, d)
    out = K.zadd(rows).withColumnRenamed("score", "last")
    for flag in ("NX", "GT", "LT"):
        out = out.join(K.zadd(rows, flag).withColumnRenamed("score", flag.lower()), ["key", "member"])
    return out.select("key", "member", *(R6(c) for c in ("last", "nx", "gt", "lt")))


def zset_incr(s, d):
    return _zlog(s, d).groupBy("key", "member").agg(F.sum("score").alias("score")).select("key", "member", R6("score"))


def number_text(s, d):
    v = F.round("l_extendedprice", 0)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.number_text(v).alias("text"))


def ts_range(s, d):
    return timeseries.ts_range(points(s, d), "click", 1704153600000000, 1704326400000000).select("ts", "seq", R6("value"))


def ts_latest(s, d):
    return timeseries.latest(points(s, d), "error", 20).select("ts", "seq", R6("value"))


def ts_average(s, d):
    return timeseries.average(points(s, d), 1704153600000000, 1705000000000000).select("series", R6("mean"))


def ts_buckets(s, d):
    return timeseries.buckets(points(s, d), 86_400_000_000).select("series", "bucket", "n", *(R6(c) for c in ("mean", "low", "high", "last")))


Z = "z AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) - 1 AS rank, count(*) OVER (PARTITION BY c_mktsegment) - row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) AS revrank FROM customer)"
MICROS = "epoch_us(ts)"
QUERIES = {
    "kv_set": (kv_set, "SELECT event_type AS key, arg_max(props, event_id) AS props FROM events GROUP BY 1"),
    "kv_setnx": (kv_setnx, "SELECT event_type AS key, arg_min(props, event_id) AS props FROM events GROUP BY 1"),
    "kv_getset": (kv_getset, "SELECT event_type AS key, event_id AS seq, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS previous FROM events"),
    "kv_incr": (kv_incr, "SELECT event_type AS key, event_id AS seq, (sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS reply FROM events"),
    "kv_append": (kv_append, "WITH a AS (SELECT event_type AS key, string_agg(user_id::VARCHAR, '' ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT key, md5(v) AS digest, strlen(v)::BIGINT AS bytes FROM a"),
    "kv_ranges": (kv_ranges, "SELECT c_custkey, c_name[1:8] AS head, c_name[-5:] AS tail, c_name[1:2] || 'XY' || c_name[5:] AS patched, strlen(c_name)::BIGINT AS bytes FROM customer"),
    "kv_command_fold": (kv_fold, None),
    "kv_ttl": (kv_ttl, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 WHEN epoch_us(ts) // 1000 <= 1705000000000 THEN -2 ELSE (epoch_us(ts) // 1000 - 1705000000000 + 500) // 1000 END::BIGINT AS ttl FROM events"),
    "kv_expire_flags": (kv_expire_flags, "WITH r AS (SELECT CASE WHEN event_id % 3 <> 0 THEN user_id * 10 END AS old, event_id AS new FROM events) SELECT count(*) FILTER (old IS NULL) AS nx, count(*) FILTER (old IS NOT NULL) AS xx, count(*) FILTER (new > old) AS gt, count(*) FILTER (old IS NULL OR new < old) AS lt FROM r"),
    "kv_exists": (kv_exists, "SELECT count(*) AS n_exists, count(DISTINCT o_custkey) AS n_deleted FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "kv_live": (kv_live, "SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 OR epoch_us(ts) // 1000 > 1705000000000 GROUP BY 1"),
    "keys_glob": (keys_glob, "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^Customer#.*[0-4].7$')"),
    "keys_prefix": (keys_prefix, "SELECT p_brand, count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') GROUP BY 1"),
    "hash_getall": (hash_all, "SELECT c_custkey AS key, 'c_mktsegment,c_name,c_nationkey' AS fields, c_mktsegment AS segment, 3::BIGINT AS n, false AS has_nope FROM customer"),
    "hash_set": (hash_set, "SELECT event_type AS key, user_id AS field, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2"),
    "hash_incr": (hash_incr, "SELECT event_type AS key, user_id AS field, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"),
    "hash_delete": (hash_delete, "SELECT f AS field, count(*) AS n FROM customer, (VALUES ('c_name'), ('c_mktsegment'), ('c_nationkey')) v(f) WHERE NOT (f = 'c_name' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) GROUP BY 1"),
    "list_range": (list_range, f"WITH {LISTS}, n AS (SELECT key, count(*) AS n FROM l GROUP BY key) SELECT key, pos, value FROM l JOIN n USING (key) WHERE pos BETWEEN greatest(0, n - 20) AND n - 3"),
    "list_remove": (list_remove, f"WITH {LISTS}, h AS (SELECT *, row_number() OVER (PARTITION BY key, value = 5 ORDER BY pos) AS r FROM l), k AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos FROM h WHERE NOT (value = 5 AND r <= 2)) SELECT key, count(*) AS n, sum(pos * value)::BIGINT AS mark FROM k GROUP BY key"),
    "list_find": (list_find, f"WITH {LISTS}, h AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS r FROM l WHERE value = 7) SELECT key, pos FROM h WHERE r BETWEEN 2 AND 4"),
    "list_trim": (list_trim, f"WITH {LISTS} SELECT key, pos - 10 AS pos, value FROM l WHERE pos BETWEEN 10 AND 19"),
    "list_command_fold": (list_fold, None),
    "list_set": (list_set, f"WITH {LISTS} SELECT key, count(*) - 2 AS pos FROM l GROUP BY key"),
    "list_insert": (list_insert, f"WITH {LISTS} SELECT key, min(pos) AS pos FROM l WHERE value = 7 GROUP BY key"),
    "list_move": (list_move, f"WITH {LISTS}, h AS (SELECT value FROM l WHERE key = 'click' AND pos = 0) SELECT key, count(*) + CASE key WHEN 'click' THEN -1 WHEN 'error' THEN 1 ELSE 0 END AS n, CASE WHEN key = 'error' THEN (SELECT value FROM h) ELSE arg_max(value, pos) END AS tail FROM l GROUP BY key"),
    "key_rename": (key_rename, "SELECT CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN (SELECT max(n_name) FROM nation) ELSE n_name END AS key, n_nationkey::BIGINT AS value FROM nation WHERE n_name <> (SELECT max(n_name) FROM nation)"),
    "key_types": (key_types, "SELECT 'zset' AS type, count(DISTINCT c_mktsegment) AS n FROM customer UNION ALL SELECT 'set', count(DISTINCT event_type) FROM events UNION ALL SELECT 'string', count(DISTINCT n_name) FROM nation"),
    "kv_msetnx": (kv_msetnx, "SELECT c_mktsegment AS key, arg_max(c_name, c_custkey) AS value FROM customer GROUP BY 1"),
    "set_random": (set_random, None),
    "set_union": (set_union, "SELECT DISTINCT user_id::VARCHAR AS member FROM events WHERE event_type IN ('click', 'error')"),
    "set_inter": (set_inter, "SELECT user_id::VARCHAR AS member FROM events WHERE event_type = 'click' INTERSECT SELECT user_id::VARCHAR FROM events WHERE event_type = 'error' INTERSECT SELECT user_id::VARCHAR FROM events WHERE event_type = 'signup'"),
    "set_diff": (set_diff, "SELECT o_custkey::VARCHAR AS member FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey::VARCHAR FROM orders WHERE o_orderstatus = 'P'"),
    "set_members": (set_members, "SELECT event_type AS key, user_id::VARCHAR AS member FROM events GROUP BY ALL HAVING max(event_id) % 4 <> 0"),
    "set_cardinality": (set_cardinality, "SELECT event_type AS key, count(DISTINCT user_id) AS n, max((user_id = 7)::INT)::BIGINT AS has_7 FROM events GROUP BY 1"),
    "set_move": (set_move, "SELECT key, count(*) AS n FROM (SELECT DISTINCT CASE WHEN event_type = 'error' AND user_id::VARCHAR < '3' THEN 'click' ELSE event_type END AS key, user_id FROM events) GROUP BY 1"),
    "zset_rank": (zset_rank, f"WITH {Z} SELECT key, member, round(score, 6) AS score, rank, revrank FROM z"),
    "zset_range": (zset_range, f"WITH {Z}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM z) SELECT key, member, round(score, 6) AS score, revrank AS rank FROM n WHERE revrank BETWEEN greatest(0, n - 10) AND n - 2"),
    "zset_range_by_score": (zset_by_score, "WITH r AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name DESC) - 1 AS n FROM customer WHERE c_acctbal > 100 AND c_acctbal <= 5000.5) SELECT key, member, round(score, 6) AS score FROM r WHERE n >= 3 AND n < 10"),
    "zset_range_by_lex": (zset_by_lex, "SELECT c_mktsegment AS key, count(*) AS n, min(c_name) AS first, max(c_name) AS last FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000050' GROUP BY 1"),
    "zset_count": (zset_count, "SELECT c_mktsegment AS key, count(*) AS card, count(*) FILTER (c_acctbal >= 0) AS n FROM customer GROUP BY 1"),
    "zset_pop": (zset_pop, f"WITH {Z} SELECT key, round(max(score) FILTER (rank < 3), 6) AS last_popped, count(*) FILTER (rank < 3) AS popped, round(min(score) FILTER (rank >= 3), 6) AS least_left, count(*) FILTER (rank >= 3) AS left FROM z GROUP BY key"),
    "zset_add": (zset_add, "SELECT event_type AS key, user_id::VARCHAR AS member, round(arg_max(value, event_id), 6) AS last, round(arg_min(value, event_id), 6) AS nx, round(max(value), 6) AS gt, round(min(value), 6) AS lt FROM events GROUP BY 1, 2"),
    "zset_incr": (zset_incr, "SELECT event_type AS key, user_id::VARCHAR AS member, round(sum(value), 6) AS score FROM events GROUP BY 1, 2"),
    "number_text": (number_text, "SELECT l_orderkey, l_linenumber, round(l_extendedprice)::BIGINT::VARCHAR AS text FROM lineitem"),
    "ts_range": (ts_range, f"SELECT {MICROS} AS ts, event_id AS seq, round(value, 6) AS value FROM events WHERE event_type = 'click' AND {MICROS} BETWEEN 1704153600000000 AND 1704326400000000"),
    "ts_latest": (ts_latest, f"SELECT {MICROS} AS ts, event_id AS seq, round(value, 6) AS value FROM events WHERE event_type = 'error' ORDER BY events.ts DESC, event_id DESC LIMIT 20"),
    "ts_average": (ts_average, f"SELECT event_type AS series, round(avg(value), 6) AS mean FROM events WHERE {MICROS} BETWEEN 1704153600000000 AND 1705000000000000 GROUP BY 1"),
    "ts_buckets": (ts_buckets, f"SELECT event_type AS series, {MICROS} // 86400000000 * 86400000000 AS bucket, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(arg_max(value, (ts, event_id)), 6) AS last FROM events GROUP BY 1, 2"),
}
