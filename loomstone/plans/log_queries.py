"""Queries over the mutation log, version control, streams, replicated state; relational and event-time extensions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import vectors as V
from loomstone.operators import mutations as M
from loomstone.operators import replicated, streams

from .tables import entries, mutations, table, vectors

R6 = lambda c: F.round(c, 6).alias(c)
MUT = "m AS (SELECT 'cust:' || lpad(o_custkey::VARCHAR, 8, '0') AS key, o_orderkey AS ts, o_totalprice AS value, o_orderstatus = 'P' AS gone FROM orders)"
LAST = "(SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS r FROM m {w})"


def current(s, d):
    return M.current(mutations(s, d)).select("key", R6("value"), "ts")


def as_of(s, d):
    return M.as_of(mutations(s, d), 7000).select("key", R6("value"), "ts")


def retained(s, d):
    return M.retained(mutations(s, d), 3000).groupBy("known").agg(F.count("*").alias("n"), F.count("value").alias("present"))


def scan_range(s, d):
    return M.scan_range(M.current(mutations(s, d)), "cust:00000200", "cust:00000100").select("key", R6("value"))


def scan_prefix(s, d):
    return M.scan_prefix(M.current(mutations(s, d)), "cust:0000010").select("key", R6("value"))


def scan_page(s, d):
    return M.page(M.current(mutations(s, d)), "cust:00000040", 10, F.col("value") > 50000).select("key", R6("value"))


def change_feed(s, d):
    log = mutations(s, d).withColumnRenamed("ts", "seq")
    return M.changes_since(log, 5000, ["cust:0000001", "cust:00000"]).groupBy("prefix").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def compacted(s, d):
    return M.compact(mutations(s, d), 8000).agg(F.count("*").alias("n"), F.sum("ts").alias("mark"))


# Version control: commits 1..5 on a line, a branch 6 from 3, over customer balances --------------------------------
COMMITS = [(1, None, None), (2, 1, None), (3, 2, None), (4, 3, None), (5, 4, None), (6, 3, None), (7, 6, None)]


def _vcs(s, d):
    commits = s.createDataFrame(COMMITS, "seq bigint, parent bigint, parent2 bigint")
    c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    rows = c.withColumn("seq", F.explode(F.expr("filter(array(1L,2L,3L,4L,5L,6L,7L), q -> q = 1 or i % (q + 1) = 0)")))
    value = F.when((F.col("seq") > 1) & (F.col("i") % (F.col("seq") + 7) == 0), F.lit(None)).otherwise(F.round(F.col("v") + F.col("seq"), 2))
    return commits, rows.select("seq", "key", value.alias("value"))


VCS = "ch AS (SELECT seq, 'c' || c_custkey AS key, CASE WHEN seq > 1 AND c_custkey % (seq + 7) = 0 THEN NULL ELSE round(c_acctbal + seq, 2) END AS value FROM customer, range(1, 8) t(seq) WHERE seq = 1 OR c_custkey % (seq + 1) = 0)"
AT = "{n} AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM ch WHERE seq IN ({s})) WHERE r = 1 AND value IS NOT NULL)"


def vcs_get(s, d):
    commits, changes = _vcs(s, d)
    g = M.graph(commits)
    return M.view_at(changes, M.ancestors(g, M.resolve(g, {"main": 5, "side": 7}, "main~1")))


def vcs_diff(s, d):
    commits, changes = _vcs(s, d)
    g = M.graph(commits)
    return M.diff(changes, M.ancestors(g, 5), M.ancestors(g, 7))


def vcs_merge(s, d):
    commits, changes = _vcs(s, d)
    g = M.graph(commits)
    return M.merge(changes, M.ancestors(g, 3), M.ancestors(g, 5), M.ancestors(g, 7))


def vcs_revert(s, d):
    commits, changes = _vcs(s, d)
    g = M.graph(commits)
    return M.revert(changes, 4, g, M.ancestors(g, 5))


def vcs_history(s, d):
    _, changes = _vcs(s, d)
    return changes.where("key = 'c12'").orderBy(F.desc("seq")).limit(4).select("seq", "value")


def vcs_log(s, d):
    commits, changes = _vcs(s, d)
    seen = sorted(M.ancestors(M.graph(commits), 7))
    return changes.where(F.col("seq").isin(seen)).groupBy("seq").agg(F.count("*").alias("n"), F.count("value").alias("written")).orderBy(F.desc("seq"))


def vcs_status(s, d):
    commits, changes = _vcs(s, d)
    working = table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.round(F.col("c_acctbal") + 1, 2).alias("value"))
    return M.status(changes, working, M.ancestors(M.graph(commits), 5)).groupBy("kind").agg(F.count("*").alias("n"))


def vcs_restore(s, d):
    commits, changes = _vcs(s, d)
    g = M.graph(commits)
    rows = M.restore(M.view_at(changes, M.ancestors(g, 5)), changes, M.ancestors(g, 1), ["c2", "c12", "c24", "c9"])
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def transaction(s, d):
    view = M.current(mutations(s, d))
    key = view.agg(F.min("key").alias("k")).first()["k"]
    ts = view.where(F.col("key") == key).first()["ts"]
    batch = view.where("ts % 2 = 0").select("key", F.when(F.col("ts") % 4 == 0, F.col("value") + 1).alias("value"), (F.col("ts") + 1).alias("ts"))
    return M.apply_batch(view, batch, {key: ts}).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# Streams -------------------------------------------------------------------------------------------------------------
IDENT = "e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS id_ms, event_id AS id_seq, user_id, value FROM events)"


def xadd(s, d):
    rows = streams.monotonic(entries(s, d), "id_seq")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("bigint")).alias("accepted"))


def xrange(s, d):
    return streams.xrange(entries(s, d), "click", "1704200000000", "(1704400000000", 50).select("id_ms", "id_seq", "user_id")


def xrevrange(s, d):
    return streams.xrange(entries(s, d), "view", "-", "+", 25, rev=True).select("id_ms", "id_seq", "user_id")


def xread(s, d):
    return streams.xread(entries(s, d), {"click": "1704500000000", "error": "0", "nope": "0"}, 10).select("key", "id_ms", "id_seq")


def xtrim(s, d):
    kept = streams.xtrim(entries(s, d), maxlen=100).groupBy("key").agg(F.count("*").alias("n"), F.min("id_ms").alias("first"))
    later = streams.xtrim(entries(s, d), minid="1705000000000").groupBy("key").agg(F.count("*").alias("later"))
    return kept.join(later, "key")


def _delivered(s, d):
    return streams.deliver(entries(s, d), ["a", "b", "c"], 5).withColumn("at", F.col("id_ms") + 1000)


def xreadgroup(s, d):
    return _delivered(s, d).groupBy("key", "consumer").agg(F.count("*").alias("n"), F.sum("id_seq").alias("mark"))


def _pending(s, d):
    given = _delivered(s, d)
    return streams.pending(given, given.where("id_seq % 3 <> 0"))


def xpending(s, d):
    return streams.pending_summary(_pending(s, d)).select("key", "consumer", "n", F.col("first.id_seq").alias("first_seq"), F.col("last.id_seq").alias("last_seq"))


def xautoclaim(s, d):
    return streams.claim(_pending(s, d), "z", 500_000_000, 1706000000000, 40).select("key", "id_ms", "id_seq", "consumer", "times")


def xinfo(s, d):
    given = _delivered(s, d).where("id_seq % 2 = 0")
    return streams.group_info(entries(s, d), given, given.where("id_seq % 3 <> 0"))


def publish(s, d):
    messages = table(s, d, "events").select(F.col("event_id").alias("msg"), F.concat("event_type", F.lit("."), F.col("user_id").cast("string")).alias("channel"))
    exact = s.createDataFrame([("click.7", "s1"), ("view.8", "s1"), ("view.8", "s2")], "channel string, subscriber string")
    return streams.publish(messages, exact, [("p1", "click.*"), ("p2", "*.7"), ("p3", "v[hi]ew.?")]).groupBy("subscriber").agg(F.count("*").alias("n"))


# Replicated state, reducers, caches, access, signals -------------------------------------------------------------------
def _ops(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("node"), F.when(F.col("event_id") % 5 == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("delta"), F.col("event_id").alias("ts"), "value")


def g_counter(s, d):
    return replicated.g_counter(_ops(s, d).withColumn("delta", F.abs("delta"))).select("name", "value")


def pn_counter(s, d):
    return replicated.pn_counter(_ops(s, d))


def crdt_merge(s, d):
    states = _ops(s, d).select("name", "node", (F.col("ts") % 97).alias("count"))
    return replicated.merge_g_counters(states)


def lww(s, d):
    return replicated.lww(_ops(s, d)).select("name", R6("value"))


def hlc(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("wall"))
    return replicated.hlc(rows).select("node", "seq", "physical", "logical")


def reduce(s, d):
    rows = table(s, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("user_id") % 7).alias("by"))
    return rows.select("key", "seq", F.sum("by").over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).alias("reply"))


def reduce_program(s, d):
    """A program per key (cell = 2 x cell + 1, kept under 1000 by a jump), run over each key's events in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = [("LoadInt", "x"), ("PushInt", 2), ("Mul",), ("PushInt", 1), ("Add",), ("Dup",), ("StoreInt", "x"), ("Return",)]
        last, cells, machine = object(), {}, None
        for batch in batches:
            out = []
            for key, seq in zip(batch.column("key").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if key != last:
                    last, cells, machine = key, {}, replicated.Machine(program)
                out.append(machine.run(cells))
            yield pa.record_batch([batch.column("key"), batch.column("seq"), pa.array(out, pa.int64())], names=["key", "seq", "reply"])

    rows = table(s, d, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"))
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, "key string, seq bigint, reply bigint")


def cache_verdicts(s, d):
    ops = F.array(*[F.lit(x) for x in ("SRCSET", "SET", "GET", "SRCDEL", "GET", "SRCSET", "GET", "INVALIDATE", "GET", "SET", "GET")])
    rows = table(s, d, "events").select(F.col("event_id").alias("seq"), F.get(ops, F.pmod("event_id", F.lit(11)).cast("int")).alias("op"), F.col("user_id").alias("key"), (F.col("event_id") % 2).alias("value"))
    return replicated.verdicts(rows)


def access(s, d):
    ok = replicated.allowed(F.col("event_type"), F.col("user_id").cast("string"), ["+@read", "-view", "+signup"], {"read": {"click", "view"}}, ["1*", "?5"])
    return table(s, d, "events").where(ok).groupBy("event_type").agg(F.count("*").alias("n"))


def signals(s, d):
    return replicated.deltas(vectors(s, d), "attr", "id", "embedding").select("id", R6("delta"))


def prune(s, d):
    """Scores above half of the threshold, the best 50 kept; the rest by tier."""
    rows = vectors(s, d).select("id", F.round(V.norm("embedding"), 6).alias("score"))
    best = rows.orderBy(F.desc("score"), "id").limit(50)
    return best.withColumn("tier", F.when(F.col("score") > 1.2, "full").when(F.col("score") > 1.0, "half").otherwise("low"))


# Extensions: general relational and event-time plans -----------------------------------------------------------------
def revenue(s, d):
    """Five-way join with small sides that the optimizer broadcasts by size."""
    c, o, l, n, r = (table(s, d, t) for t in ("customer", "orders", "lineitem", "nation", "region"))
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def pricing(s, d):
    l = table(s, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))


def cube(s, d):
    rows = table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


def tumbling(s, d):
    rows = table(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


def sessions(s, d):
    rows = table(s, d, "events").groupBy(F.session_window(F.col("ts").cast("timestamp"), "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return rows.select(F.unix_seconds("session_window.start").alias("start"), "user_id", "n")


def quantiles(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.99)), 6).alias("p99"))


def asof_join(s, d):
    """For each error the last click of the same user at or before it, by a union and a running last."""
    e = table(s, d, "events").where("event_type in ('error', 'click')").select("event_id", "ts", "user_id", (F.col("event_type") == "click").alias("is_click"))
    order = Window.partitionBy("user_id").orderBy("ts", F.desc("is_click"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = e.withColumn("click", F.last(F.when(F.col("is_click"), F.col("event_id")), ignorenulls=True).over(order))
    return rows.where("not is_click").select("event_id", "click")


QUERIES = {
    "log_current": (current, f"WITH {MUT} SELECT key, round(value, 6) AS value, ts FROM {LAST.format(w='')} WHERE r = 1 AND NOT gone"),
    "log_as_of": (as_of, f"WITH {MUT} SELECT key, round(value, 6) AS value, ts FROM {LAST.format(w='WHERE ts <= 7000')} WHERE r = 1 AND NOT gone"),
    "log_retained": (retained, f"WITH {MUT}, f AS (SELECT key, count(*) > 8 AS pruned, min(ts) FILTER (n <= 8) AS floor FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS n FROM m) GROUP BY key), v AS (SELECT key, value FROM {LAST.format(w='WHERE ts <= 3000')} WHERE r = 1 AND NOT gone) SELECT NOT pruned OR floor <= 3000 AS known, count(*) AS n, count(value) AS present FROM f LEFT JOIN v USING (key) GROUP BY 1"),
    "scan_range": (scan_range, f"WITH {MUT} SELECT key, round(value, 6) AS value FROM {LAST.format(w='')} WHERE r = 1 AND NOT gone AND key >= 'cust:00000100' AND key < 'cust:00000200'"),
    "scan_prefix": (scan_prefix, f"WITH {MUT} SELECT key, round(value, 6) AS value FROM {LAST.format(w='')} WHERE r = 1 AND NOT gone AND starts_with(key, 'cust:0000010')"),
    "scan_page": (scan_page, f"WITH {MUT}, p AS (SELECT key, value FROM {LAST.format(w='')} WHERE r = 1 AND NOT gone AND key > 'cust:00000040' ORDER BY key LIMIT 10) SELECT key, round(value, 6) AS value FROM p WHERE p.value > 50000"),
    "change_feed": (change_feed, f"WITH {MUT} SELECT p AS prefix, count(*) AS n, min(ts) AS first FROM m, (VALUES ('cust:0000001'), ('cust:00000')) v(p) WHERE ts > 5000 AND starts_with(key, p) GROUP BY 1"),
    "log_compact": (compacted, f"WITH {MUT}, c AS (SELECT ts FROM {LAST.format(w='WHERE ts <= 8000')} WHERE r = 1 AND NOT gone UNION ALL SELECT ts FROM m WHERE ts > 8000) SELECT count(*) AS n, sum(ts)::BIGINT AS mark FROM c"),
    "vcs_get": (vcs_get, f"WITH {VCS}, {AT.format(n='a', s='1, 2, 3, 4')} SELECT key, value FROM a"),
    "vcs_diff": (vcs_diff, f"WITH {VCS}, {AT.format(n='a', s='1, 2, 3, 4, 5')}, {AT.format(n='b', s='1, 2, 3, 6, 7')} SELECT coalesce(a.key, b.key) AS key, a.value AS before, b.value AS after, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value"),
    "vcs_merge": (vcs_merge, f"WITH {VCS}, {AT.format(n='b', s='1, 2, 3')}, {AT.format(n='o', s='1, 2, 3, 4, 5')}, {AT.format(n='t', s='1, 2, 3, 6, 7')} SELECT k.key, CASE WHEN b.value IS NOT DISTINCT FROM o.value THEN t.value ELSE o.value END AS value, o.value IS DISTINCT FROM t.value AND b.value IS DISTINCT FROM o.value AND b.value IS DISTINCT FROM t.value AS conflict FROM (SELECT DISTINCT key FROM ch WHERE seq > 3) k LEFT JOIN b USING (key) LEFT JOIN o USING (key) LEFT JOIN t USING (key)"),
    "vcs_revert": (vcs_revert, f"WITH {VCS}, {AT.format(n='b', s='1, 2, 3')}, {AT.format(n='h', s='1, 2, 3, 4, 5')} SELECT c.key, b.value, h.value IS DISTINCT FROM c.value AS conflict FROM (SELECT * FROM ch WHERE seq = 4) c LEFT JOIN b USING (key) LEFT JOIN h USING (key)"),
    "vcs_history": (vcs_history, f"WITH {VCS} SELECT seq, value FROM ch WHERE key = 'c12' ORDER BY seq DESC LIMIT 4"),
    "vcs_log": (vcs_log, f"WITH {VCS} SELECT seq, count(*) AS n, count(value) AS written FROM ch WHERE seq IN (1, 2, 3, 6, 7) GROUP BY seq"),
    "vcs_status": (vcs_status, f"WITH {VCS}, {AT.format(n='a', s='1, 2, 3, 4, 5')}, w AS (SELECT 'c' || c_custkey AS key, round(c_acctbal + 1, 2) AS value FROM customer WHERE c_custkey % 3 <> 0) SELECT CASE WHEN a.key IS NULL THEN 'added' WHEN w.key IS NULL THEN 'deleted' ELSE 'modified' END AS kind, count(*) AS n FROM a FULL JOIN w ON a.key = w.key WHERE a.value IS DISTINCT FROM w.value GROUP BY 1"),
    "vcs_restore": (vcs_restore, f"WITH {VCS}, {AT.format(n='a', s='1, 2, 3, 4, 5')}, {AT.format(n='b', s='1')}, r AS (SELECT * FROM a WHERE key NOT IN ('c2', 'c12', 'c24', 'c9') UNION ALL SELECT * FROM b WHERE key IN ('c2', 'c12', 'c24', 'c9')) SELECT count(*) AS n, round(sum(value), 2) AS total FROM r"),
    "transaction": (transaction, f"WITH {MUT}, c AS (SELECT key, ts, value FROM {LAST.format(w='')} WHERE r = 1 AND NOT gone) SELECT count(*) FILTER (ts % 2 = 1 OR ts % 4 = 0) AS n, round(sum(CASE WHEN ts % 2 = 1 THEN value WHEN ts % 4 = 0 THEN value + 1 END), 2) AS total FROM c"),
    "stream_add": (xadd, f"WITH {IDENT}, o AS (SELECT *, max(id_ms) OVER (PARTITION BY key ORDER BY id_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT key, count(*) AS n, count(*) FILTER (top IS NULL OR id_ms >= top) AS accepted FROM o GROUP BY key"),
    "stream_range": (xrange, f"WITH {IDENT} SELECT id_ms, id_seq, user_id FROM e WHERE key = 'click' AND id_ms >= 1704200000000 AND id_ms <= 1704400000000 ORDER BY 1, 2 LIMIT 50"),
    "stream_revrange": (xrevrange, f"WITH {IDENT} SELECT id_ms, id_seq, user_id FROM e WHERE key = 'view' ORDER BY 1 DESC, 2 DESC LIMIT 25"),
    "stream_read": (xread, f"WITH {IDENT}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms, id_seq) AS n FROM e WHERE key = 'click' AND (id_ms > 1704500000000 OR id_ms = 1704500000000 AND id_seq > 0) OR key = 'error') SELECT key, id_ms, id_seq FROM r WHERE n <= 10"),
    "stream_trim": (xtrim, f"WITH {IDENT}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms DESC, id_seq DESC) AS n FROM e) SELECT key, count(*) FILTER (n <= 100) AS n, min(id_ms) FILTER (n <= 100) AS first, count(*) FILTER (id_ms >= 1705000000000) AS later FROM r GROUP BY key"),
    "stream_group_read": (xreadgroup, f"WITH {IDENT}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms, id_seq) - 1 AS n FROM e) SELECT key, ['a', 'b', 'c'][(n // 5) % 3 + 1] AS consumer, count(*) AS n, sum(id_seq)::BIGINT AS mark FROM r GROUP BY ALL"),
    "stream_pending": (xpending, f"WITH {IDENT}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms, id_seq) - 1 AS n FROM e), p AS (SELECT key, ['a', 'b', 'c'][(n // 5) % 3 + 1] AS consumer, id_ms, id_seq FROM r WHERE id_seq % 3 = 0) SELECT key, consumer, count(*) AS n, arg_min(id_seq, (id_ms, id_seq)) AS first_seq, arg_max(id_seq, (id_ms, id_seq)) AS last_seq FROM p GROUP BY ALL"),
    "stream_autoclaim": (xautoclaim, f"WITH {IDENT} SELECT key, id_ms, id_seq, 'z' AS consumer, 2::BIGINT AS times FROM e WHERE id_seq % 3 = 0 AND 1706000000000 - id_ms - 1000 >= 500000000 ORDER BY key, id_ms, id_seq LIMIT 40"),
    "stream_info": (xinfo, f"WITH {IDENT} SELECT key, count(*) AS length, arg_max(id_ms, (id_ms, id_seq)) AS id_ms, arg_max(id_seq, (id_ms, id_seq)) AS id_seq, count(*) FILTER (id_seq % 2 = 0) AS entries_read, count(*) FILTER (id_seq % 6 = 0) AS pending, count(*) FILTER (id_seq % 2 = 1) AS lag FROM e GROUP BY key"),
    "publish": (publish, "WITH m AS (SELECT event_type || '.' || user_id AS c FROM events) SELECT s AS subscriber, count(*) AS n FROM (SELECT 's1' AS s FROM m WHERE c IN ('click.7', 'view.8') UNION ALL SELECT 's2' FROM m WHERE c = 'view.8' UNION ALL SELECT 'p1' FROM m WHERE c LIKE 'click.%' UNION ALL SELECT 'p2' FROM m WHERE c LIKE '%.7' UNION ALL SELECT 'p3' FROM m WHERE regexp_matches(c, '^v[hi]ew\\..$')) GROUP BY 1"),
    "crdt_gcounter": (g_counter, "SELECT event_type AS name, sum(user_id)::BIGINT AS value FROM events GROUP BY 1"),
    "crdt_pncounter": (pn_counter, "SELECT event_type AS name, sum(CASE WHEN event_id % 5 = 0 THEN -user_id ELSE user_id END)::BIGINT AS value FROM events GROUP BY 1"),
    "crdt_merge": (crdt_merge, "SELECT name, sum(c)::BIGINT AS value FROM (SELECT event_type AS name, user_id, max(event_id % 97) AS c FROM events GROUP BY 1, 2) GROUP BY 1"),
    "crdt_lww": (lww, "SELECT event_type AS name, round(arg_max(value, (event_id, user_id)), 6) AS value FROM events GROUP BY 1"),
    "hybrid_clock": (hlc, "WITH w AS (SELECT user_id AS node, event_id AS seq, max(epoch_us(ts) // 86400000000) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS physical FROM events) SELECT node, seq, physical, row_number() OVER (PARTITION BY node, physical ORDER BY seq) - 1 AS logical FROM w"),
    "reducer_counter": (reduce, "SELECT event_type AS key, event_id AS seq, (sum(user_id % 7) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS reply FROM events"),
    "reducer_program": (reduce_program, None),
    "cache_verdicts": (cache_verdicts, "WITH e AS (SELECT event_id AS seq, user_id AS key, event_id % 2 AS value, ['SRCSET', 'SET', 'GET', 'SRCDEL', 'GET', 'SRCSET', 'GET', 'INVALIDATE', 'GET', 'SET', 'GET'][event_id % 11 + 1] AS op FROM events), g AS (SELECT seq, key, op, last_value(CASE WHEN op IN ('SET', 'INVALIDATE') THEN {'o': op, 'v': value} END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN op IN ('SRCSET', 'SRCDEL') THEN {'o': op, 'v': value} END IGNORE NULLS) OVER w AS s FROM e WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT seq, key, CASE WHEN c IS NULL OR c.o = 'INVALIDATE' THEN 'MISS' WHEN s IS NULL OR s.o = 'SRCDEL' THEN 'PHANTOM' WHEN c.v = s.v THEN 'HIT' ELSE 'STALE_HIT' END AS verdict FROM g WHERE op = 'GET'"),
    "access_rules": (access, "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'signup') AND (starts_with(user_id::VARCHAR, '1') OR regexp_matches(user_id::VARCHAR, '^.5$')) GROUP BY 1"),
    "proxy_delta": (signals, "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT id, round(coalesce(list_distance(e, b) / sqrt(sqrt(len(e))), 0.0), 6) AS delta FROM p"),
    "score_prune": (prune, "WITH s AS (SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 50) SELECT id, score, CASE WHEN score > 1.2 THEN 'full' WHEN score > 1.0 THEN 'half' ELSE 'low' END AS tier FROM s"),
    "sql_revenue": (revenue, "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "sql_pricing": (pricing, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "sql_cube": (cube, "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "window_tumbling": (tumbling, "SELECT epoch_us(ts) // 21600000000 * 21600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "window_session": (sessions, "WITH b AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT epoch_us(min(ts)) // 1000000 AS start, user_id, count(*) AS n FROM g GROUP BY user_id, g"),
    "quantiles": (quantiles, "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1"),
    "asof_join": (asof_join, "SELECT e.event_id, (SELECT arg_max(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND c.ts <= e.ts) AS click FROM events e WHERE e.event_type = 'error'"),
}
