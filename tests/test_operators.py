import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import keyspace, memory, mutations, replicated, streams, timeseries, vector
from loomstone.sources import fbin
from loomstone.sources.log import MutationLog


def test_time_series(spark):
    rows = [("a", 100, 0, 11.0), ("a", 100, 1, 12.0), ("a", 100, 2, 13.0), ("a", 50, 3, 5.0), ("b", 10, 4, 42.5), ("b", 20, 5, 66.25)]
    p = spark.createDataFrame(rows, "series string, ts bigint, seq bigint, value double")
    assert [r["value"] for r in timeseries.ts_range(p, "a", 0, 200).collect()] == [5, 11, 12, 13]
    assert timeseries.ts_range(p, "a", 700, 100).count() == 0
    assert [r["value"] for r in timeseries.latest(p, "a", 2).collect()] == [12, 13] and timeseries.latest(p, "a", 0).count() == 0
    assert {r["series"]: r["mean"] for r in timeseries.average(p, 0, 100).collect()}["b"] == 54.375


def test_search_join(spark):
    tickets = spark.createDataFrame([("1", "open"), ("2", "closed"), ("3", "open"), ("x", "open")], "pk string, status string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.95, 0.05]), (3, [0.8, 0.2])], "id bigint, embedding array<float>")
    assert [r["id"] for r in vector.filtered_join(tickets, "status", "open", v, [1, 0], 5).collect()] == [1, 3]


def test_batch_equals_single_queries(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, r.normal(size=8).astype(float).tolist()) for i in range(300)], "id bigint, embedding array<float>")
    q = v.where("id < 7").withColumnRenamed("id", "qid")
    monkeypatch.setattr(vector, "BLOCK", 3)
    got = {}
    for row in vector.batch_topk(v, q, 4).collect():
        got.setdefault(row["qid"], []).append((row["rank"], row["id"]))
    for row in q.collect():
        assert [i for _, i in sorted(got[row["qid"]])] == [x["id"] for x in vector.topk(v, row["embedding"], 4).collect()]


def test_mmr_weighs_novelty(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.7, 0.7])], "id bigint, embedding array<float>")
    assert [r["id"] for r in vector.mmr(v, [1, 0], 2, 1.0).collect()] == [1, 2]
    assert [r["id"] for r in vector.mmr(v, [1, 0], 2, 0.2).collect()] == [1, 3]


def test_ivf_recall(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(3, 8))
    v = spark.createDataFrame([(i, (centres[i % 3] + 0.35 * r.normal(size=8)).tolist()) for i in range(600)], "id bigint, embedding array<float>").cache()
    cells, hits = vector.ivf_fit(v, 8), 0
    for row in v.where("id < 10").collect():
        exact = {x["id"] for x in vector.topk(v, row["embedding"], 10).collect()}
        hits += len(exact & {x["id"] for x in vector.ivf_topk(v, cells, row["embedding"], 10, 4).collect()})
    assert hits >= 90


def test_valid_times(spark):
    e = [1.0] * 4
    ltm = spark.createDataFrame([(1, "she is CTO", e, "s", 0.5, "alice", 1000, 2000), (2, "she is CEO", e, "s", 0.5, "alice", 2000, 0), (3, "secret CEO", e, "s", 0.5, "bob", 0, 0)], "id bigint, text string, embedding array<float>, source string, salience double, owner string, valid_from bigint, valid_to bigint")
    asked = lambda rows, t: [r["id"] for r in memory.recall(rows, "alice", "CEO CTO", e, 5, t).collect()]
    assert asked(ltm, 1500) == [1] and asked(ltm, 3000) == [2]
    ended = memory.invalidate(ltm, spark.createDataFrame([(2, "alice", 4000), (3, "alice", 4000)], "id bigint, owner string, at bigint"))
    assert asked(ended, 5000) == [] and ended.where("id = 3").first()["valid_to"] == 0


def test_graph(spark):
    edges = spark.createDataFrame([("alice", "works_at", "acme", 0.9), ("acme", "located_in", "nyc", 1.0), ("alice", "reports_to", "bob", 0.7), ("nyc", "home_of", "alice", 1.0)], "src string, rel string, dst string, weight double")
    assert memory.neighbours(edges, "alice").count() == 2
    assert {(r["id"], r["depth"]) for r in memory.traverse(edges, "alice", 2).collect()} == {("alice", 0), ("acme", 1), ("bob", 1), ("nyc", 2)}
    assert {r["id"] for r in memory.traverse(edges, "alice", 5, "works_at").collect()} == {"alice", "acme"}


def test_string_and_list_folds_against_a_model(spark):
    r = random.Random(3)
    cmds = [(f"k{r.randint(1, 4)}", i, r.choice(["SET", "SETNX", "SETXX", "GET", "GETDEL", "APPEND", "DEL"]), r.choice(["1", "2", "x"])) for i in range(400)]
    got = {(x["key"], x["seq"]): x["reply"] for x in keyspace.fold(spark.createDataFrame(cmds, "key string, seq bigint, cmd string, value string"), keyspace.string_step).collect()}
    state = {}
    for k, i, c, v in cmds:
        old = state.get(k)
        want = {"GET": old, "GETDEL": old, "DEL": str(int(old is not None)), "SET": "OK"}.get(c)
        if c in ("GETDEL", "DEL"):
            state.pop(k, None)
        elif c == "SET" or (c == "SETNX" and old is None) or (c == "SETXX" and old is not None):
            state[k], want = v, "OK"
        elif c == "APPEND":
            state[k] = (old or "") + v
            want = str(len(state[k]))
        assert got[k, i] == want
    cmds = [(f"k{r.randint(1, 3)}", i, r.choice(["LPUSH", "RPUSH", "LPOP", "RPOP", "LLEN"]), str(i)) for i in range(300)]
    got = {(x["key"], x["seq"]): x["reply"] for x in keyspace.fold(spark.createDataFrame(cmds, "key string, seq bigint, cmd string, value string"), keyspace.list_step).collect()}
    lists = {}
    for k, i, c, v in cmds:
        xs = lists.setdefault(k, [])
        if c == "LPUSH":
            xs.insert(0, v)
        elif c == "RPUSH":
            xs.append(v)
        want = (xs.pop(0 if c == "LPOP" else -1) if xs else None) if c in ("LPOP", "RPOP") else str(len(xs))
        assert got[k, i] == want


@pytest.mark.parametrize(("count", "left"), [(0, "bcb"), (1, "bacba"), (-1, "abacb"), (2, "bcba"), (-9, "bcb")])
def test_list_remove(spark, count, left):
    rows = spark.createDataFrame([("l", i, x) for i, x in enumerate("abacba")], "key string, pos int, value string")
    assert "".join(r["value"] for r in keyspace.list_remove(rows, F.lit("a"), count).orderBy("pos").collect()) == left


def test_score_bounds(spark):
    z = spark.createDataFrame([("z", m, float(s)) for s, m in enumerate("abcde")], "key string, member string, score double")
    ask = lambda *a, **k: "".join(r["member"] for r in keyspace.zrange_by_score(z, *a, **k).orderBy("score").collect())
    assert ask("(1", "+inf") == "cde" and ask("-inf", "(3") == "abc" and ask("-inf", "+inf", 1, 2) == "bc" and ask("-inf", "+inf", 1, 2, rev=True) == "cd" and ask("-inf", "+inf", -1, 2) == ""
    popped, left = keyspace.zpop(z, 2, largest=True)
    assert {r["member"] for r in popped.collect()} == set("de") and left.count() == 3


def test_mutation_log(spark, tmp_path):
    log = MutationLog(spark, f"{tmp_path}/log")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, ts bigint, value double, is_deleted boolean")
    log.append(rows(("a", 1, 1.0, False), ("b", 2, 2.0, False)), 0)
    log.append(rows(("a", 3, 3.0, False), ("b", 4, None, True)), 1)
    log.append(rows(("a", 3, 3.0, False), ("b", 4, None, True)), 1)  # the same batch again
    assert log.read().count() == 4
    assert {r["key"]: r["value"] for r in log.current().collect()} == {"a": 3.0}
    assert {r["key"]: r["value"] for r in log.as_of(2).collect()} == {"a": 1.0, "b": 2.0}
    kept = MutationLog(spark, log.snapshot("s", 3))
    assert {r["key"]: r["value"] for r in kept.current().collect()} == {"a": 3.0} and kept.read().count() == 3


def test_merge_conflicts(spark):
    changes = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0), (2, "a", 2.0), (2, "b", 2.0), (3, "a", 3.0), (3, "c", None), (3, "b", 2.0)], "seq bigint, key string, value double")
    g = {1: [], 2: [1], 3: [1]}
    a, o, t = (mutations.ancestors(g, x) for x in (1, 2, 3))
    got = {r["key"]: (r["value"], r["conflict"]) for r in mutations.merge(changes, a, o, t).collect()}
    assert got["a"][1] and got["b"] == (2.0, False) and got["c"] == (None, False)
    assert {r["key"]: r["value"] for r in mutations.merge(changes, a, o, t, "THEIRS").collect()}["a"] == 3.0
    assert mutations.resolve(g, {"main": 3}, "main~1") == 1 == mutations.resolve(g, {"main": 3}, "main^")


def test_stack_machine():
    m = replicated.Machine([("LoadInt", "x"), ("PushInt", 5), ("Add",), ("Dup",), ("StoreInt", "x"), ("Return",)])
    cells = {}
    assert [m.run(cells), m.run(cells)] == [5, 10] and cells == {"x": 10}
    assert replicated.Machine([("PushInt", 2**63 - 1), ("PushInt", 1), ("Add",), ("Return",)]).run({}) == -(2**63)
    loop = replicated.Machine([("Jump", 0)])
    assert [loop.run(cells) for _ in range(4)] == [None] * 4 and loop.strikes == 3
    trap = replicated.Machine([("PushInt", 9), ("StoreInt", "x"), ("Trap",)])
    assert trap.run(cells) is None and cells == {"x": 10}
    assert replicated.Machine([("PushInt", 0), ("JumpIfZero", 4), ("PushInt", 1), ("Return",), ("PushInt", 2), ("Return",)]).run({}) == 2


def test_merging_counters(spark):
    a = [("c", 1, 5), ("c", 2, 7)]
    b = [("c", 1, 6), ("c", 3, 1)]
    merged = lambda *x: replicated.merge_g_counters(spark.createDataFrame([y for s in x for y in s], "name string, node bigint, count bigint")).first()["value"]
    assert merged(a, b) == 14 == merged(b, a) == merged(a, b, a)


def test_stream_ids(spark):
    e = spark.createDataFrame([("s", 5, 0, 0), ("s", 5, 1, 1), ("s", 4, 9, 2), ("s", 6, 0, 3)], "key string, id_ms bigint, id_seq bigint, n int")
    assert [r["accepted"] for r in streams.monotonic(e, "n").orderBy("n").collect()] == [True, True, False, True]
    ask = lambda *a, **k: [(r["id_ms"], r["id_seq"]) for r in streams.xrange(e, "s", *a, **k).collect()]
    assert ask("5", "5") == [(5, 0), (5, 1)] and ask("(5-0", "+") == [(5, 1), (6, 0)] and ask("-", "+", 1, rev=True) == [(6, 0)]


def test_vector_files(spark, tmp_path):
    x = np.array([[3.0, 4.0], [0.0, 0.0]], np.float32)
    (tmp_path / "v.fbin").write_bytes(fbin.to_bytes(x))
    rows = fbin.read(spark, str(tmp_path / "v.fbin")).orderBy("id").collect()
    assert [r["id"] for r in rows] == [0, 1] and np.allclose(rows[0]["embedding"], [0.6, 0.8])
    for bad in (b"\1", struct.pack("<II", 0, 2), struct.pack("<II", 5, 2) + b"\0" * 8):
        (tmp_path / "bad.fbin").write_bytes(bad)
        with pytest.raises(Exception, match="truncated"):
            fbin.read(spark, str(tmp_path / "bad.fbin")).collect()
