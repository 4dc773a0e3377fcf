import pytest

from loomstone.plans.commands import CommandError, Store


@pytest.fixture(scope="module")
def store(spark):
    df = spark.createDataFrame
    e = [1.0, 0.0]
    return Store(spark, {
        "kv": df([("a", "one", None), ("b", "two", 50), ("c", "three", 5000)], "key string, value string, expire_at bigint"),
        "hash": df([("h", "y", "2"), ("h", "x", "1")], "key string, field string, value string"),
        "list": df([("l", i, v) for i, v in enumerate("abcab")], "key string, pos int, value string"),
        "set": df([("s", "1"), ("s", "2"), ("t", "2"), ("t", "3")], "key string, member string"),
        "zset": df([("z", m, float(i)) for i, m in enumerate("abcde")], "key string, member string, score double"),
        "stream": df([("x", 5, 0), ("x", 5, 1), ("x", 7, 0)], "key string, id_ms bigint, id_seq bigint"),
        "ts": df([("cpu", 100, 0, 11.0), ("cpu", 300, 1, 30.0), ("cpu", 100, 2, 10.0)], "series string, ts bigint, seq bigint, value double"),
        "vectors": df([(1, [1.0, 0.0], 0, "n"), (2, [0.9, 0.1], 1, "n"), (3, [0.0, 1.0], 0, "m")], "id bigint, embedding array<float>, attr int, ns string"),
        "payload": df([(1, '{"c": "x"}'), (2, '{"c": "y"}')], "id bigint, doc string"),
        "edges": df([("a", "r", "b", 1.0), ("b", "r", "c", 1.0)], "src string, rel string, dst string, weight double"),
        "ltm": df([(1, "rust engine", e, "doc", 0.5, "al", 0, 0), (2, "python tool", e, "doc", 0.5, "bo", 0, 0)], "id bigint, text string, embedding array<float>, source string, salience double, owner string, valid_from bigint, valid_to bigint"),
        "log": df([("k", 1, 1.0, False), ("k", 5, 2.0, False)], "key string, ts bigint, value double, is_deleted boolean"),
        "rows": df([("users", "1", {"tier": "pro"}), ("users", "2", {"tier": "free"}), ("users", "3", {"tier": "pro"})], "table string, pk string, cols map<string,string>"),
    }, now=100)


def ask(store, *command):
    return [tuple(r) for r in store.execute(*command).collect()]


@pytest.mark.parametrize(
    ("command", "reply"),
    [
        (("GET", "a"), [("one",)]), (("GET", "b"), []), (("MGET", "c", "nope", "a"), [("c", "three"), ("nope", None), ("a", "one")]), (("EXISTS", "a", "a", "b"), [(2,)]), (("STRLEN", "c"), [(5,)]),
        (("GETRANGE", "c", 1, -2), [("hre",)]), (("TTL", "c"), [(5,)]), (("TTL", "a"), [(-1,)]), (("KEYS", "*"), [("a",), ("c",)]), (("DBSIZE",), [(2,)]), (("TYPE", "z"), [("zset",)]),
        (("HGETALL", "h"), [("x", "1"), ("y", "2")]), (("HMGET", "h", "y", "q"), [("y", "2"), ("q", None)]), (("HEXISTS", "h", "x"), [(1,)]), (("HLEN", "h"), [(2,)]), (("HLEN", "none"), [(0,)]),
        (("LRANGE", "l", 1, -2), [("b",), ("c",), ("a",)]), (("LINDEX", "l", -1), [("b",)]), (("LPOS", "l", "a", -1), [(3,)]),
        (("SINTER", "s", "t"), [("2",)]), (("SDIFF", "s", "t"), [("1",)]), (("SUNION", "s", "t", "no"), [("1",), ("2",), ("3",)]), (("SISMEMBER", "s", "9"), [(0,)]),
        (("ZRANGE", "z", 1, 2), [("z", "b", 1.0, 1), ("z", "c", 2.0, 2)]), (("ZRANGEBYSCORE", "z", "(1", "+inf", "LIMIT", 1, 1), [("z", "d", 3.0)]), (("ZREVRANGEBYSCORE", "z", "3", "-inf", "LIMIT", 0, 2), [("z", "d", 3.0), ("z", "c", 2.0)]),
        (("ZRANGEBYLEX", "z", "[b", "(d"), [("z", "b", 1.0), ("z", "c", 2.0)]), (("ZREVRANK", "z", "a"), [(4, 0.0)]), (("ZCOUNT", "z", "(0", "3"), [(3,)]),
        (("XRANGE", "x", "5", "5"), [("x", 5, 0), ("x", 5, 1)]), (("XLEN", "x"), [(3,)]), (("TSRANGE", "cpu", 0, 200), [(100, 11.0), (100, 10.0)]), (("TSAVG", "cpu", 0, 1000), [(17.0,)]), (("TSRANGE.LATEST", "cpu", 1), [(300, 30.0)]),
        (("VLISTNS",), [("m", 1), ("n", 2)]), (("VFACET", "c"), [("x", 1), ("y", 1)]), (("MEM.NEIGH", "a"), [("b", "r", 1.0)]), (("MEM.COUNT",), [(2,)]),
        (("GETAT", "k", 3), [(1.0,)]), (("SCANRANGE", "z", "a"), [("k", 2.0, 5)]), (("TABLE.FILTEREQ", "users", "tier", "pro"), [("1", {"tier": "pro"}), ("3", {"tier": "pro"})]),
        (("RAG.CONTEXT", "al", 1, "rust", "1 0"), [("[1] (doc) rust engine\n",)]),
    ],
)
def test_reads(store, command, reply):
    assert ask(store, *command) == reply


def test_vector_commands(store):
    ids = lambda *c: [r[0] for r in ask(store, *c)]
    assert ids("VSEARCH", 2, 1, 0) == [1, 2] and ids("VSEARCH", 2, "F", 0, "1, 0") == [1, 3]
    assert ids("VSEARCHNS", "n", 5, "1 0") == [1, 2] and ids("VSEARCHNS", "n", 5, "PFILTER", '{"must": [{"key": "c", "match": {"value": "y"}}]}', 1, 0) == [2]
    assert ids("VSEARCHNS", "n", 5, "RADIUS", 0.001, 1, 0) == [1] and ids("VRECOMMEND", "n", 1, 0.5, "POS", 2) == [2]
    assert [r[0] for r in ask(store, "MEM.RECALL", "AGENT", "al", 3, "rust", 1, 0)] == [1]
    assert {r[0] for r in ask(store, "MEM.TRAV", "a", 2)} == {"a", "b", "c"}
    with pytest.raises(CommandError):
        store.execute("VRECOMMEND", "n", 1, 0.5, "POS")


def test_writes_give_a_new_store(store):
    new = store.execute("SET", "a", "1").execute("SET", "n", "x", "XX").execute("HSET", "h", "x", "9", "w", "0").execute("HDEL", "h", "y").execute("ZADD", "z", 9, "a", 1, "q").execute("ZREM", "z", "b")
    new = new.execute("LPUSH", "l", "p", "q").execute("RPUSH", "l", "r").execute("SADD", "s", "7", "1").execute("SREM", "s", "2").execute("LREM", "l", 1, "a")
    assert ask(new, "GET", "a") == [("1",)] and ask(new, "GET", "n") == [] and ask(new, "HGETALL", "h") == [("w", "0"), ("x", "9")]
    assert [r[1] for r in ask(new, "ZRANGE", "z", 0, -1)] == ["q", "c", "d", "e", "a"]
    assert "".join(r[0] for r in ask(new, "LRANGE", "l", 0, -1)) == "qpbcabr" and ask(new, "SMEMBERS", "s") == [("1",), ("7",)]
    assert ask(store, "GET", "a") == [("one",)] and ask(store, "LLEN", "l") == [(5,)]
    with pytest.raises(CommandError):
        store.execute("NOPE")


def test_more_writes(store):
    run = lambda *c: store.execute(*c)
    assert ask(run("INCRBY", "n", 5).execute("INCRBY", "n", -7), "GET", "n") == [("-2",)]
    with pytest.raises(CommandError):
        run("INCRBY", "a", 1)
    assert ask(run("APPEND", "a", "!"), "GET", "a") == [("one!",)] and ask(run("APPEND", "q", "!"), "GET", "q") == [("!",)]
    assert ask(run("EXPIRE", "a", 3), "TTL", "a") == [(3,)] and ask(run("EXPIRE", "a", 3, "XX"), "TTL", "a") == [(-1,)] and ask(run("EXPIRE", "a", -3), "EXISTS", "a") == [(0,)]
    assert ask(run("PERSIST", "c"), "TTL", "c") == [(-1,)] and ask(run("HINCRBY", "h", "x", 4), "HGET", "h", "x") == [("5",)]
    text = lambda s: "".join(r[0] for r in ask(s, "LRANGE", "l", 0, -1))
    assert text(run("LPOP", "l", 2)) == "cab" and text(run("RPOP", "l")) == "abca" and text(run("LSET", "l", -1, "z")) == "abcaz" and text(run("LINSERT", "l", "AFTER", "b", "n")) == "abncab"
    assert text(run("LTRIM", "l", 1, 2)) == "bc" and text(run("LMOVE", "l", "l", "LEFT", "RIGHT")) == "bcaba"
    assert ask(run("SUNIONSTORE", "s", "s", "t"), "SCARD", "s") == [(3,)] and ask(run("SINTERSTORE", "s", "s", "none"), "SCARD", "s") == [(0,)] and ask(run("SMOVE", "s", "t", "1"), "SCARD", "t") == [(3,)]
    names = lambda s: "".join(r[1] for r in ask(s, "ZRANGE", "z", 0, -1))
    assert names(run("ZINCRBY", "z", 2.5, "a")) == "bcade" and names(run("ZPOPMAX", "z", 2)) == "abc" and names(run("ZREMRANGEBYRANK", "z", 1, -2)) == "ae"
    assert names(run("ZREMRANGEBYSCORE", "z", "(1", "3")) == "abe" and names(run("ZREMRANGEBYLEX", "z", "-", "(c")) == "cde"
    assert ask(run("XADD", "x", "8-1"), "XREVRANGE", "x", "+", "-", 1) == [("x", 8, 1)] and ask(run("XADD", "x", "*"), "XLEN", "x") == [(4,)]
    with pytest.raises(CommandError):
        run("XADD", "x", "7-0")
    assert ask(run("XDEL", "x", "5-1"), "XLEN", "x") == [(2,)] and ask(run("XTRIM", "x", "MAXLEN", 1), "XRANGE", "x", "-", "+") == [("x", 7, 0)]
    assert ask(run("TSADD", "cpu", 50, 1), "TSRANGE", "cpu", 0, 60) == [(50, 1.0)]


def test_vector_and_memory_writes(store):
    run = lambda *c: store.execute(*c)
    assert [r[0] for r in ask(run("VADDNS", "n", 9, "1 0.01"), "VSEARCHNS", "n", 2, 1, 0)] == [1, 9] and [r[0] for r in ask(run("VDEL", 1), "VSEARCH", 1, 1, 0)] == [2]
    with pytest.raises(CommandError):
        run("VADD", 4, 1, 2, 3)
    assert ask(run("VSETPAYLOAD", 3, '{"c": "x"}'), "VFACET", "c") == [("x", 2), ("y", 1)]
    new = run("MEM.REMEMBER", "al", "rust again", "doc", 0.9, 1, 0)
    assert [r[0] for r in ask(new, "MEM.RECALL", "AGENT", "al", 3, "rust", 1, 0)] == [3, 1]
    assert [r[0] for r in ask(new.execute("MEM.INVALIDATE", 3, "al", 50), "MEM.RECALL", "AGENT", "al", 3, "rust", 1, 0)] == [1]
    assert ask(new.execute("MEM.FORGET", 3, "bo"), "MEM.COUNT") == [(3,)] and ask(new.execute("MEM.FORGET", 3, "al"), "MEM.COUNT") == [(2,)]
    assert ask(new.execute("MEM.CONSOLIDATE", 3, 0.9), "MEM.GET", 3) == [("rust again", "doc", 1.0)]
    assert len(ask(run("MEM.LINK", "a", "r", "z", 2.0), "MEM.NEIGH", "a")) == 2 and ask(run("MEM.UNLINK", "a", "r", "b"), "MEM.NEIGH", "a") == []
    assert len(ask(run("TABLE.UPSERT", "users", "2", {"tier": "pro"}), "TABLE.FILTEREQ", "users", "tier", "pro")) == 3
