from pyspark.sql import functions as F

from loomstone.sources.log import MutationLog
from loomstone.streaming import groups, windows


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_windows_equal_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    run(windows.tumbling(stream, "1 day", "1 hour"), "tumbling", "complete")
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    got = spark.table("tumbling").select("start", "event_type", "n")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_change_feed_into_a_log(spark, tmp_path):
    rows = spark.createDataFrame([("user:1", 1, 1.0, False), ("user:2", 2, 2.0, False), ("job:1", 3, 3.0, False)], "key string, ts bigint, value double, is_deleted boolean")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    log = MutationLog(spark, f"{tmp_path}/log")
    q = stream.writeStream.foreachBatch(log.sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert log.current().count() == 3
    run(windows.change_feed(stream, ["user:", "user:1"]), "feed")
    assert sorted((r["key"], r["prefix"]) for r in spark.table("feed").collect()) == [("user:1", "user:"), ("user:1", "user:1"), ("user:2", "user:")]


def test_consumer_group(spark, tmp_path):
    cmds = [("s", 1, 0, "ADD", None, "1-0"), ("s", 2, 1, "ADD", None, "2-0"), ("s", 3, 2, "ADD", None, "3-0"), ("s", 4, 10, "READ", "a", "2"), ("s", 5, 11, "ACK", None, "1-0"), ("s", 6, 12, "READ", "b", "5"), ("s", 7, 30, "CLAIM", "b", "15"), ("s", 8, 31, "ACK", None, "9-9"), ("t", 1, 0, "READ", "a", "1")]
    df = spark.createDataFrame(cmds, "key string, seq bigint, at bigint, cmd string, consumer string, arg string")
    df.where("seq <= 4").coalesce(1).write.parquet(f"{tmp_path}/g")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/g")
    df.where("seq > 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/g")
    run(groups.run(stream), "groups")
    got = {(r["key"], r["seq"]): r["reply"] for r in spark.table("groups").collect()}
    state, want = {}, {}
    for k, i, at, c, who, arg in cmds:
        want[k, i] = groups.step(state.setdefault(k, {}), {"cmd": c, "at": at, "consumer": who, "arg": arg})
    assert got == want and want["s", 4] == "1-0,2-0" and want["s", 7] == "2-0,3-0"


def test_keys_expire_when_the_watermark_passes_their_deadline(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "key string, value string, ts timestamp"
    for k, rows in enumerate([[("a", "1", at(10)), ("b", "2", at(90))], [("a", "old", at(5)), ("c", "3", at(95)), ("z", "late", at(20))], [("d", "4", at(200))], [("e", "5", at(201))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = windows.expiring(stream, "1 minute").writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"], r["value"], r["event"]) for r in spark.table("expired").collect()}
    assert {("a", "1", "set"), ("a", "1", "expired"), ("b", "2", "set"), ("b", "2", "expired"), ("c", "3", "set"), ("c", "3", "expired"), ("d", "4", "set")} <= got
    assert not any(value in ("old", "late") for _, value, _ in got) and ("d", "4", "expired") not in got


def commands(rnd, n):
    at, rows = 0, []
    for seq in range(n):
        at += rnd.choice([0, 1, 1, 2, 5, -3])
        cmd = rnd.choice(["ADD", "ADD", "ADD", "READ", "ACK", "CLAIM"])
        low, high = {"ADD": (0, 40), "READ": (-2, 6), "ACK": (0, 40), "CLAIM": (-2, 12)}[cmd]
        rows.append({"seq": seq, "at": at, "cmd": cmd, "consumer": rnd.choice("ab"), "arg": str(rnd.randint(low, high))})
    return rows


def test_parts_of_a_group_reply_alone_as_the_plain_fold(monkeypatch):
    import random
    from types import SimpleNamespace

    import pandas as pd
    import pyarrow as pa

    for name, value in (("CHUNK", 3), ("ROWS", 17), ("TEXT", 200), ("PART_TEXT", 60), ("PART_TIMES", 0)):
        monkeypatch.setattr(groups, name, value)
    for seed in range(40):
        rnd = random.Random(seed)
        rows, state = commands(rnd, 400), SimpleNamespace(exists=False)
        state.update = lambda value, state=state: vars(state).update(exists=True, get=value)
        record = []
        for batch in (rows[:250], rows[250:]):
            frame = pd.DataFrame(rnd.sample(batch, len(batch)))
            record += [f for f in groups._record(("s",), iter([frame[:100], frame[100:]]), state)]
        parts = [p.sort_values("nth") for _, p in pd.concat(record).groupby("part")]
        assert len(parts) > 5
        rnd.shuffle(parts)
        got = {r["seq"]: r["reply"] for p in parts for b in groups._spell(iter([pa.RecordBatch.from_pandas(p)])) for r in b.to_pylist()}
        plain = {}
        assert got == {r["seq"]: groups.step(plain, r) for r in rows}


def test_consumer_group_query_writes_in_proportion_to_its_commands(spark, tmp_path, monkeypatch):
    from loomstone.plans import streaming_queries as Q

    made, folder = [], Q.scratch.folder
    monkeypatch.setattr(Q.scratch, "folder", lambda s, name: made.append((name, folder(s, name))) or made[-1][1])
    wrote, text = [], []
    for n in (5_000, 40_000):
        events = spark.range(n).select(F.col("id").alias("event_id"), F.element_at(F.array(*map(F.lit, ("view", "click", "error"))), (F.col("id") * 7919 % 10007 % 3 + 1).cast("int")).alias("event_type"), (F.col("id") % 11).alias("user_id"))
        events.coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        rows = Q.consumer_groups(spark, f"{tmp_path}/{n}")
        assert rows.columns == ["key", "seq", "reply"] and rows.count() == n
        text.append(rows.agg(F.sum(F.length("reply"))).first()[0])
        wrote.append(sum(r["length"] for r in spark.read.format("binaryFile").load([f for name, f in made if name == "stream"][-1] + "/*").select("length").collect()))
    assert text[1] > 30 * text[0] and wrote[1] < 10 * wrote[0]
