"""Commands by name over registered tables: each gives a DataFrame, planned only when it is read.

``Store(spark, tables)`` takes the logical tables by model (any may be missing):
``kv(key, value[, expire_at])``, ``hash(key, field, value)``, ``list(key, pos, value)``, ``set(key, member)``,
``zset(key, member, score)``, ``stream(key, id_ms, id_seq, ...)``, ``ts(series, ts, seq, value)``,
``vectors(id, embedding[, attr, ns])``, ``payload(id, doc)``, ``edges(src, rel, dst, weight)``, ``ltm(...)``,
``episodes(agent, seq, kind, payload)``, ``wm(agent, key, value, seq, expires_at)``, ``log(key, ts, value, is_deleted)``,
``rows(table, pk, cols map)``. Write commands return the store with the table changed; a store itself never changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import payload
from loomstone.functions import text as T
from loomstone.operators import keyspace as K
from loomstone.operators import memory, mutations, streams, timeseries, vector


class CommandError(ValueError):
    pass


def _floats(args: tuple) -> list[float]:
    """One number an argument, or one string of numbers apart by spaces or commas."""
    if len(args) == 1 and isinstance(args[0], str):
        args = tuple(args[0].replace(",", " ").split())
    return [float(x) for x in (args[0] if len(args) == 1 and isinstance(args[0], (list, tuple)) else args)]


class Store:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], now: int = 0):
        self.spark, self.tables, self.now = spark, dict(tables), now

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise CommandError(f"no table {name}")
        return self.tables[name]

    def of(self, name: str, key: str) -> DataFrame:
        return self.table(name).where(F.col("key") == key)

    def changed(self, name: str, df: DataFrame) -> Store:
        return Store(self.spark, {**self.tables, name: df}, self.now)

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def execute(self, command: str, *args):
        """The DataFrame of a read command, or the new store of a write command."""
        try:
            run = COMMANDS[command.upper()]
        except KeyError:
            raise CommandError(f"unknown command {command}") from None
        return run(self, *args)


def _live(s: Store) -> DataFrame:
    kv = s.table("kv")
    return K.live(kv, s.now) if "expire_at" in kv.columns else kv


def _vsearch(s: Store, k, *args) -> DataFrame:
    """VSEARCH k [F category | H n term weight ...] numbers."""
    if args[0] == "F":
        return vector.topk(s.table("vectors"), _floats(args[2:]), int(k), F.col("attr") == int(args[1]))
    if args[0] == "H":
        n = int(args[1])
        terms = {int(args[2 + 2 * i]): float(args[3 + 2 * i]) for i in range(n)}
        return vector.hybrid(s.table("vectors"), _floats(args[2 + 2 * n :]), terms, int(k))
    return vector.topk(s.table("vectors"), _floats(args), int(k))


def _vsearchns(s: Store, ns, k, *args) -> DataFrame:
    """VSEARCHNS ns k [PFILTER json | MMR weight | RADIUS most | F category] numbers."""
    rows = s.table("vectors").where(F.col("ns") == ns)
    if args[0] == "PFILTER":
        held = s.table("payload")
        kept = held.where(payload.compile_filter(args[1], F.col("doc"), F.col("id"))).select("id")
        return vector.topk(rows.join(kept, "id"), _floats(args[2:]), int(k))
    if args[0] == "MMR":
        return vector.mmr(rows, _floats(args[2:]), int(k), float(args[1]))
    if args[0] == "RADIUS":
        return vector.radius(rows, _floats(args[2:]), int(k), float(args[1]))
    if args[0] == "F":
        return vector.topk(rows, _floats(args[2:]), int(k), F.col("attr") == int(args[1]))
    return vector.topk(rows, _floats(args), int(k))


def _vrecommend(s: Store, ns, k, weight, *args) -> DataFrame:
    """VRECOMMEND ns k weight POS ids NEG ids; the weight has no effect."""
    rows = s.table("vectors").where(F.col("ns") == ns)
    cut = args.index("NEG") if "NEG" in args else len(args)
    liked, disliked = [int(x) for x in args[1:cut]], [int(x) for x in args[cut + 1 :]]
    if args[0] != "POS" or not liked:
        raise CommandError("VRECOMMEND needs an example")
    return vector.recommend(rows, rows.where(F.col("id").isin(liked)), rows.where(F.col("id").isin(disliked)), int(k))


def _zrange(s: Store, key, start, stop, *options) -> DataFrame:
    """ZRANGE key start stop [BYSCORE | BYLEX] [REV] [LIMIT offset count]; with REV the greater bound comes first."""
    words = [str(o).upper() for o in options]
    rows, rev = s.of("zset", key), "REV" in words
    offset, count = (int(options[words.index("LIMIT") + i]) for i in (1, 2)) if "LIMIT" in words else (0, -1)
    if "BYSCORE" in words or "BYLEX" in words:
        low, high = (stop, start) if rev else (start, stop)
        if "BYLEX" in words:
            rows = rows.where(K.lex_bound(F.col("member"), low, True) & K.lex_bound(F.col("member"), high, False))
            low, high = "-inf", "+inf"
        out = K.zrange_by_score(rows, str(low), str(high), offset, count, rev)
        return out.orderBy(*((F.desc("score"), F.desc("member")) if rev else ("score", "member")))
    if "LIMIT" in words:
        raise CommandError("LIMIT needs BYSCORE or BYLEX")
    return K.zrange(rows, int(start), int(stop), rev).orderBy("rank")


def _recall(as_of: bool) -> Callable[..., DataFrame]:
    """MEM.RECALL [AGENT name] k query numbers, and with a time at the end the view as of then."""

    def run(s: Store, k, query, *args) -> DataFrame:
        scope = "default"
        if k == "AGENT":
            scope, k, query, *args = query, *args
        *numbers, t = args if as_of else (*args, s.now)
        return memory.recall(s.table("ltm"), scope, query, _floats(tuple(numbers)), int(k), int(t))

    return run


def _sets(op: str) -> Callable[..., DataFrame]:
    return lambda s, *keys: K.set_algebra(s.table("set"), op, list(keys)).orderBy("member")


def _count(name: str) -> Callable[..., DataFrame]:
    return lambda s, key: s.of(name, key).agg(F.count("*").alias("n"))


def _without(name: str, column: str) -> Callable[..., Store]:
    return lambda s, key, *gone: s.changed(name, s.table(name).where(~((F.col("key") == key) & F.col(column).isin([str(x) for x in gone]))))


def _upsert(name: str, column: str, kind: str) -> Callable[..., Store]:
    """Pairs replace what the key has under the same names."""

    def run(s: Store, key, *pairs) -> Store:
        rows = [(key, *((pairs[i + 1], float(pairs[i])) if name == "zset" else (pairs[i], pairs[i + 1]))) for i in range(0, len(pairs), 2)]
        new = s.values(list({r[1]: r for r in rows}.values()), kind)
        return s.changed(name, s.table(name).select(new.columns).join(new, ["key", column], "left_anti").select(new.columns).unionByName(new))

    return run


def _set(s: Store, key, value, *options) -> Store:
    kv = s.table("kv")
    here = not kv.where(F.col("key") == key).isEmpty()
    words = [str(o).upper() for o in options]
    if "NX" in words and "XX" in words:
        raise CommandError("NX and XX")
    if ("NX" in words and here) or ("XX" in words and not here):
        return s
    return s.changed("kv", kv.select("key", "value").where(F.col("key") != key).unionByName(s.values([(key, str(value))], "key string, value string")))


def _push(left: bool) -> Callable[..., Store]:
    def run(s: Store, key, *values) -> Store:
        rows = s.table("list")
        n = s.of("list", key).agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("n")).first()["n"]
        new = s.values([(key, -1.0 - i if left else float(n + 1 + i), v) for i, v in enumerate(values)], f"key string, _o double, value {dict(rows.dtypes)['value']}")
        both = rows.select("key", F.col("pos").cast("double").alias("_o"), "value").unionByName(new)
        return s.changed("list", K.numbered(both, "_o").drop("_o"))

    return run


def _replace(s: Store, name: str, gone, *new: DataFrame) -> Store:
    """The table without the rows of a predicate and with the new rows."""
    out = s.table(name).where(~gone)
    for df in new:
        out = out.unionByName(df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in out.dtypes]))
    return s.changed(name, out)


def _vadd(s: Store, ident, *numbers, ns: str = "") -> Store:
    """VADD: the category comes from the vector; its dimension must be that of the vectors there."""
    from loomstone.functions import vectors as V

    x, rows = _floats(numbers), s.table("vectors")
    first = rows.first()
    if first is not None and len(first["embedding"]) != len(x):
        raise CommandError("dimension")
    new = s.values([(int(ident), x, ns)], "id bigint, embedding array<float>, ns string").withColumn("attr", V.category("embedding"))
    gone = F.col("id") == int(ident)
    return _replace(s, "vectors", gone & (F.col("ns") == ns) if "ns" in rows.columns else gone, new)


def _zincrby(s: Store, key, by, member) -> Store:
    old = s.of("zset", key).where(F.col("member") == member).first()
    return COMMANDS["ZADD"](s, key, (old["score"] if old else 0.0) + float(by), member)


def _incrby(s: Store, key, by=1) -> Store:
    old = s.of("kv", key).first()
    if old is not None and str(old["value"]) != str(int(old["value"]) if str(old["value"]).lstrip("-").isdigit() else ""):
        raise CommandError("not an integer")
    total = int(old["value"] if old else 0) + int(by)
    if not -(2**63) <= total < 2**63:
        raise CommandError("overflow")
    new = s.values([(key, str(total), old["expire_at"] if old and "expire_at" in old else None)], "key string, value string, expire_at bigint")
    return _replace(s, "kv", F.col("key") == key, new)


def _expire(s: Store, key, seconds, flag: str | None = None) -> Store:
    """EXPIRE: a deadline that is past deletes the key."""
    at = F.lit(s.now + 1000 * int(seconds))
    kv = s.table("kv")
    hit = (F.col("key") == key) & K.expire_allowed(F.col("expire_at"), at, flag and flag.upper())
    return s.changed("kv", K.live(kv.withColumn("expire_at", F.when(hit, at).otherwise(F.col("expire_at"))), s.now))


def _store(op: str) -> Callable[..., Store]:
    """S...STORE: the result takes the place of the target; an empty one removes it."""
    return lambda s, target, *keys: _replace(s, "set", F.col("key") == target, K.set_algebra(s.table("set"), op, list(keys)).withColumn("key", F.lit(target)))


def _zremove(pick: Callable) -> Callable[..., Store]:
    def run(s: Store, key, a, b) -> Store:
        gone = pick(s.of("zset", key), a, b).select("key", "member")
        return s.changed("zset", s.table("zset").join(gone, ["key", "member"], "left_anti"))

    return run


def _lex(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(K.lex_bound(F.col("member"), a, True) & K.lex_bound(F.col("member"), b, False))


def _zpop(largest: bool) -> Callable[..., Store]:
    def run(s: Store, key, n=1) -> Store:
        gone = K.zpop(s.of("zset", key), int(n), largest)[0].select("key", "member")
        return s.changed("zset", s.table("zset").join(gone, ["key", "member"], "left_anti"))

    return run


def _pop(left: bool) -> Callable[..., Store]:
    def run(s: Store, key, n=1) -> Store:
        kept = K.list_range(s.of("list", key), int(n), -1) if left else K.list_range(s.of("list", key), 0, -1 - int(n))
        return _replace(s, "list", F.col("key") == key, K.numbered(kept.withColumnRenamed("pos", "_o"), "_o"))

    return run


def _list_edit(edit: Callable[..., DataFrame]) -> Callable[..., Store]:
    return lambda s, key, *a: _replace(s, "list", F.col("key") == key, edit(s.of("list", key), *a))


def _xadd(s: Store, key, ident: str, **fields) -> Store:
    """XADD: an id that is not above the last one is an error; ``*`` is the time or one above the last."""
    last = s.of("stream", key).agg(F.max(F.struct("id_ms", "id_seq")).alias("m")).first()["m"]
    if ident == "*":
        ms, seq = (s.now, 0) if last is None or last["id_ms"] < s.now else (last["id_ms"], last["id_seq"] + 1)
    else:
        ms, seq, _ = streams.parse_id(ident, True)
    if last is not None and (ms, seq) <= tuple(last):
        raise CommandError("id is not above the last one")
    return _replace(s, "stream", F.lit(False), s.values([(key, ms, seq, *fields.values())], ", ".join(["key string, id_ms bigint, id_seq bigint", *(f"{f} string" for f in fields)])))


def _tsadd(s: Store, series, ts, value) -> Store:
    seq = s.table("ts").where(F.col("series") == series).agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).first()["n"]
    return _replace(s, "ts", F.lit(False), s.values([(series, int(ts), int(seq), float(value))], "series string, ts bigint, seq bigint, value double"))


def _remember(s: Store, owner, text, source, salience, *numbers, valid_from: int = 0, valid_to: int = 0) -> Store:
    ident = s.table("ltm").agg(F.coalesce(F.max("id") + 1, F.lit(1)).alias("n")).first()["n"]
    new = s.values([(int(ident), text, _floats(numbers), source, float(salience), owner, valid_from, valid_to)], "id bigint, text string, embedding array<float>, source string, salience double, owner string, valid_from bigint, valid_to bigint")
    return _replace(s, "ltm", F.lit(False), new)


def _link(s: Store, a, rel, b, weight=1.0) -> Store:
    here = (F.col("src") == a) & (F.col("rel") == rel) & (F.col("dst") == b)
    return _replace(s, "edges", here, s.values([(a, rel, b, float(weight))], "src string, rel string, dst string, weight double"))


def _owned(change: Callable, kind: str) -> Callable[..., Store]:
    return lambda s, *row: s.changed("ltm", change(s.table("ltm"), s.values([row], kind)).select(s.table("ltm").columns))


COMMANDS: dict[str, Callable] = {
    # strings and keys
    "GET": lambda s, key: _live(s).where(F.col("key") == key).select("value"),
    "MGET": lambda s, *keys: s.values([(k, i) for i, k in enumerate(keys)], "key string, i int").join(_live(s), "key", "left").orderBy("i").select("key", "value"),
    "EXISTS": lambda s, *keys: s.values([(k,) for k in keys], "key string").join(_live(s).select("key"), "key").agg(F.count("*").alias("n")),
    "STRLEN": lambda s, key: _live(s).where(F.col("key") == key).select(F.octet_length("value").alias("n")),
    "GETRANGE": lambda s, key, a, b: _live(s).where(F.col("key") == key).select(K.byte_range(F.col("value"), int(a), int(b)).alias("value")),
    "TTL": lambda s, key: s.of("kv", key).select(K.ttl_seconds(F.col("expire_at"), s.now).alias("ttl")),
    "KEYS": lambda s, pattern: _live(s).where(T.keys_match(F.col("key"), pattern)).select("key").orderBy("key"),
    "DBSIZE": lambda s: _live(s).agg(F.count("*").alias("n")),
    "TYPE": lambda s, key: K.types({("string" if m == "kv" else m): s.tables[m] for m in ("kv", "hash", "list", "set", "zset", "stream") if m in s.tables}).where(F.col("key") == key).select("type"),
    "SET": _set,
    "DEL": lambda s, *keys: s.changed("kv", s.table("kv").where(~F.col("key").isin(list(keys)))),
    "RENAME": lambda s, a, b: s.changed("kv", K.rename(s.table("kv"), a, b)),
    "RENAMENX": lambda s, a, b: s.changed("kv", K.rename(s.table("kv"), a, b, only_new=True)),
    # hashes
    "HGET": lambda s, key, field: s.of("hash", key).where(F.col("field") == field).select("value"),
    "HMGET": lambda s, key, *fields: s.values([(f, i) for i, f in enumerate(fields)], "field string, i int").join(s.of("hash", key), "field", "left").orderBy("i").select("field", "value"),
    "HGETALL": lambda s, key: s.of("hash", key).select("field", "value").orderBy("field"),
    "HKEYS": lambda s, key: s.of("hash", key).select("field").orderBy("field"),
    "HVALS": lambda s, key: s.of("hash", key).orderBy("field").select("value"),
    "HEXISTS": lambda s, key, field: s.of("hash", key).agg(F.coalesce(F.max((F.col("field") == field).cast("int")), F.lit(0)).alias("n")),
    "HLEN": _count("hash"), "HSET": _upsert("hash", "field", "key string, field string, value string"), "HDEL": _without("hash", "field"),
    # lists
    "LRANGE": lambda s, key, a, b: K.list_range(s.of("list", key), int(a), int(b)).orderBy("pos").select("value"),
    "LINDEX": lambda s, key, i: K.list_range(s.of("list", key), int(i), int(i)).select("value"),
    "LPOS": lambda s, key, value, rank=1, count=1: K.list_find(s.of("list", key), F.lit(value), int(rank), int(count)).select("pos"),
    "LLEN": _count("list"), "LPUSH": _push(True), "RPUSH": _push(False),
    "LTRIM": lambda s, key, a, b: s.changed("list", s.table("list").where(F.col("key") != key).select("key", "pos", "value").unionByName(K.numbered(K.list_range(s.of("list", key), int(a), int(b)).withColumnRenamed("pos", "_o"), "_o").select("key", "pos", "value"))),
    "LREM": lambda s, key, n, value: s.changed("list", s.table("list").where(F.col("key") != key).select("key", "pos", "value").unionByName(K.list_remove(s.of("list", key), F.lit(value), int(n)).select("key", "pos", "value"))),
    "LMOVE": lambda s, a, b, x, y: s.changed("list", K.list_move(s.table("list"), a, b, x.upper() == "LEFT", y.upper() == "LEFT")),
    # sets
    "SMEMBERS": lambda s, key: s.of("set", key).select("member").distinct().orderBy("member"),
    "SCARD": lambda s, key: s.of("set", key).agg(F.countDistinct("member").alias("n")),
    "SISMEMBER": lambda s, key, m: s.of("set", key).agg(F.coalesce(F.max((F.col("member") == m).cast("int")), F.lit(0)).alias("n")),
    "SUNION": _sets("union"), "SINTER": _sets("inter"), "SDIFF": _sets("diff"), "SREM": _without("set", "member"),
    "SADD": lambda s, key, *ms: s.changed("set", s.table("set").unionByName(s.values([(key, str(m)) for m in ms], "key string, member string")).distinct()),
    "SRANDMEMBER": lambda s, key, n=1, seed=0: K.random_members(s.of("set", key), int(n), seed).select("member"),
    # sorted sets
    "ZRANGE": _zrange,
    "ZREVRANGE": lambda s, key, a, b: _zrange(s, key, a, b, "REV"),
    "ZRANGEBYSCORE": lambda s, key, a, b, *o: _zrange(s, key, a, b, "BYSCORE", *o),
    "ZREVRANGEBYSCORE": lambda s, key, a, b, *o: _zrange(s, key, a, b, "BYSCORE", "REV", *o),
    "ZRANGEBYLEX": lambda s, key, a, b, *o: _zrange(s, key, a, b, "BYLEX", *o),
    "ZREVRANGEBYLEX": lambda s, key, a, b, *o: _zrange(s, key, a, b, "BYLEX", "REV", *o),
    "ZRANK": lambda s, key, m: K.zranked(s.of("zset", key)).where(F.col("member") == m).select("rank", "score"),
    "ZREVRANK": lambda s, key, m: K.zranked(s.of("zset", key)).where(F.col("member") == m).select(F.col("revrank").alias("rank"), "score"),
    "ZSCORE": lambda s, key, m: s.of("zset", key).where(F.col("member") == m).select("score"),
    "ZCOUNT": lambda s, key, a, b: s.of("zset", key).where(K.bound(F.col("score"), str(a), True) & K.bound(F.col("score"), str(b), False)).agg(F.count("*").alias("n")),
    "ZLEXCOUNT": lambda s, key, a, b: s.of("zset", key).where(K.lex_bound(F.col("member"), a, True) & K.lex_bound(F.col("member"), b, False)).agg(F.count("*").alias("n")),
    "ZCARD": _count("zset"), "ZADD": _upsert("zset", "member", "key string, member string, score double"), "ZREM": _without("zset", "member"),
    # streams and time series
    "XRANGE": lambda s, key, a, b, count=None: streams.xrange(s.table("stream"), key, a, b, count),
    "XREVRANGE": lambda s, key, b, a, count=None: streams.xrange(s.table("stream"), key, a, b, count, rev=True),
    "XREAD": lambda s, count, after: streams.xread(s.table("stream"), after, int(count)),
    "XLEN": _count("stream"),
    "TSRANGE": lambda s, series, a, b: timeseries.ts_range(s.table("ts"), series, int(a), int(b)).select("ts", "value"),
    "TSRANGE.LATEST": lambda s, series, n: timeseries.latest(s.table("ts"), series, int(n)).select("ts", "value"),
    "TSAVG": lambda s, series, a, b: timeseries.average(s.table("ts").where(F.col("series") == series), int(a), int(b)).select("mean"),
    # vectors
    "VSEARCH": _vsearch, "VSEARCHNS": _vsearchns, "VRECOMMEND": _vrecommend,
    "VSEARCH.MANY": lambda s, k, queries: vector.batch_topk(s.table("vectors"), queries, int(k)),
    "VLISTNS": lambda s: s.table("vectors").groupBy("ns").agg(F.count("*").alias("n")).orderBy("ns"),
    "VGETPAYLOAD": lambda s, i: s.table("payload").where(F.col("id") == int(i)).select("doc"),
    "VFACET": lambda s, path, k=10: s.table("payload").select(F.explode(payload.labels(F.col("doc"), path)).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(int(k)),
    # memory
    "MEM.RECALL": _recall(False), "MEM.RECALL.AS_OF": _recall(True),
    "MEM.GET": lambda s, i: s.table("ltm").where(F.col("id") == int(i)).select("text", "source", "salience"),
    "MEM.COUNT": lambda s: s.table("ltm").agg(F.count("*").alias("n")),
    "MEM.NEIGH": lambda s, node, rel=None: memory.neighbours(s.table("edges"), node, rel),
    "MEM.INCOMING": lambda s, node, rel=None: memory.neighbours(s.table("edges"), node, rel, incoming=True),
    "MEM.TRAV": lambda s, node, depth, rel=None: memory.traverse(s.table("edges"), node, int(depth), rel),
    "MEM.EPISODES": lambda s, agent, n: memory.episodes(s.table("episodes"), agent, int(n)),
    "MEM.WM_GET": lambda s, agent, key: memory.working(s.table("wm"), agent, s.now).where(F.col("key") == key).select("value"),
    "RAG.SEARCH": lambda s, scope, k, query, *v: memory.retrieve(s.table("ltm"), scope, query, _floats(v), int(k), s.now),
    "RAG.CONTEXT": lambda s, scope, k, query, *v: memory.context(memory.retrieve(s.table("ltm"), scope, query, _floats(v), int(k), s.now)),
    # the log and tables
    "GETAT": lambda s, key, snapshot: mutations.as_of(s.of("log", key), int(snapshot)).select("value"),
    "SCANRANGE": lambda s, a, b: mutations.scan_range(mutations.current(s.table("log")), a, b),
    "TABLE.SCAN": lambda s, name: s.table("rows").where(F.col("table") == name).select("pk", "cols").orderBy("pk"),
    "TABLE.FILTEREQ": lambda s, name, column, value: s.table("rows").where((F.col("table") == name) & (F.col("cols")[column] == value)).select("pk", "cols").orderBy("pk"),
    # more writes
    "INCRBY": _incrby, "INCR": _incrby, "DECRBY": lambda s, key, by=1: _incrby(s, key, -int(by)), "EXPIRE": _expire,
    "PERSIST": lambda s, key: s.changed("kv", s.table("kv").withColumn("expire_at", F.when(F.col("key") != key, F.col("expire_at")))),
    "APPEND": lambda s, key, more: s.changed("kv", s.table("kv").withColumn("value", F.when(F.col("key") == key, F.concat("value", F.lit(more))).otherwise(F.col("value")))) if not s.of("kv", key).isEmpty() else _set(s, key, more),
    "HINCRBY": lambda s, key, field, by: COMMANDS["HSET"](s, key, field, str(int((s.of("hash", key).where(F.col("field") == field).first() or {"value": 0})["value"]) + int(by))),
    "LPOP": _pop(True), "RPOP": _pop(False), "LSET": _list_edit(lambda rows, i, v: K.list_set(rows, int(i), F.lit(v))),
    "LINSERT": _list_edit(lambda rows, where, pivot, v: K.list_insert(rows, F.lit(pivot), F.lit(v), where.upper() == "BEFORE")),
    "SUNIONSTORE": _store("union"), "SINTERSTORE": _store("inter"), "SDIFFSTORE": _store("diff"),
    "SMOVE": lambda s, a, b, m: COMMANDS["SADD"](COMMANDS["SREM"](s, a, m), b, m) if not s.of("set", a).where(F.col("member") == m).isEmpty() else s,
    "ZINCRBY": _zincrby, "ZPOPMIN": _zpop(False), "ZPOPMAX": _zpop(True), "ZREMRANGEBYLEX": _zremove(_lex),
    "ZREMRANGEBYSCORE": _zremove(lambda rows, a, b: K.zrange_by_score(rows, str(a), str(b))), "ZREMRANGEBYRANK": _zremove(lambda rows, a, b: K.zrange(rows, int(a), int(b))),
    "XADD": _xadd, "XDEL": lambda s, key, *ids: s.changed("stream", s.table("stream").where(~((F.col("key") == key) & F.concat_ws("-", "id_ms", "id_seq").isin(list(ids))))),
    "XTRIM": lambda s, key, how, n: _replace(s, "stream", F.col("key") == key, streams.xtrim(s.of("stream", key), **({"maxlen": int(n)} if how.upper() == "MAXLEN" else {"minid": str(n)}))),
    "TSADD": _tsadd,
    "VADD": _vadd, "VADDNS": lambda s, ns, ident, *numbers: _vadd(s, ident, *numbers, ns=ns),
    "VDEL": lambda s, *ids: s.changed("vectors", s.table("vectors").where(~F.col("id").isin([int(i) for i in ids]))),
    "VSETPAYLOAD": lambda s, i, doc: _replace(s, "payload", F.col("id") == int(i), s.values([(int(i), doc)], "id bigint, doc string")),
    "VDELPAYLOAD": lambda s, i: s.changed("payload", s.table("payload").where(F.col("id") != int(i))),
    "MEM.REMEMBER": _remember, "RAG.INGEST": lambda s, owner, text, source, *numbers: _remember(s, owner, text, source, 0.5, *numbers),
    "MEM.LINK": _link, "MEM.UNLINK": lambda s, a, rel, b: s.changed("edges", s.table("edges").where(~((F.col("src") == a) & (F.col("rel") == rel) & (F.col("dst") == b)))),
    "MEM.INVALIDATE": _owned(memory.invalidate, "id bigint, owner string, at bigint"), "MEM.FORGET": _owned(memory.forget, "id bigint, owner string"), "MEM.CONSOLIDATE": _owned(memory.consolidate, "id bigint, delta double"),
    "TABLE.UPSERT": lambda s, name, pk, cols: _replace(s, "rows", (F.col("table") == name) & (F.col("pk") == pk), s.values([(name, pk, cols)], "table string, pk string, cols map<string,string>")),
}
