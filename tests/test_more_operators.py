from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import keyspace, mutations, quantize, vector


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 32))
    x = [(i, (centres[i % 6] + 0.5 * r.normal(size=32)).tolist()) for i in range(800)]
    return spark.createDataFrame(x, "id bigint, embedding array<float>").cache()


@pytest.mark.parametrize("kind", [quantize.Product, quantize.Rotated])
def test_recall_of_codes(cloud, kind):
    codec, hits = kind.fit(quantize.sampled(cloud, 800)), 0
    for row in cloud.where("id < 5").collect():
        exact = {r["id"] for r in vector.topk(cloud, row["embedding"], 10).collect()}
        hits += len(exact & {r["id"] for r in quantize.coded_topk(cloud, row["embedding"], 10, codec, 8).collect()})
    assert hits >= 45


def test_estimates_are_near_the_inner_products():
    x = quantize.unit(np.random.default_rng(1).normal(size=(400, 64)))
    for codec in (quantize.Rotated.fit(x, bits=3), quantize.Product.fit(x, parts=32, codes=32)):
        s = codec.scores(x, x[0]) if isinstance(codec, quantize.Rotated) else codec.scores(codec.encode(x), x[0])
        assert np.corrcoef(s, x @ x[0])[0, 1] > 0.9
    assert quantize.tiers(np.array([1.0, 0.3, -0.6, 0.1])).tolist() == [2, 1, -2, 0]


def test_probes_reach_the_target(cloud):
    cells = vector.ivf_fit(cloud, 12)
    queries = [r["embedding"] for r in cloud.where("id < 4").collect()]
    assert 1 <= vector.calibrate(cloud, cells, queries, 10, 0.5) <= vector.calibrate(cloud, cells, queries, 10, 0.95) <= 12


def test_lists(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate("xyz")] + [("b", 0, "q")], "key string, pos int, value string")
    text = lambda df, k="a": "".join(r["value"] for r in df.where(F.col("key") == k).orderBy("pos").collect())
    assert text(keyspace.list_set(rows, -1, F.lit("w"))) == "xyw"
    assert text(keyspace.list_insert(rows, F.lit("y"), F.lit("n"))) == "xnyz" and text(keyspace.list_insert(rows, F.lit("y"), F.lit("n"), before=False)) == "xynz" and text(keyspace.list_insert(rows, F.lit("?"), F.lit("n"))) == "xyz"
    moved = keyspace.list_move(rows, "a", "b", from_left=False, to_left=True)
    assert (text(moved), text(moved, "b")) == ("xy", "zq")
    assert text(keyspace.list_move(rows, "a", "a", from_left=True, to_left=False)) == "yzx"
    assert keyspace.list_move(rows, "none", "b", True, True).count() == 4


def test_random_members(spark):
    rows = spark.createDataFrame([(k, str(i)) for k in "ab" for i in range(9)], "key string, member string")
    few = [(r["key"], r["member"]) for r in keyspace.random_members(rows, 4, 1).collect()]
    assert Counter(k for k, _ in few) == {"a": 4, "b": 4} and len(set(few)) == 8
    many = keyspace.random_members(rows, -20, 1).collect()
    assert Counter(r["key"] for r in many) == {"a": 20, "b": 20}


def test_rename(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    assert {(r["key"], r["value"]) for r in keyspace.rename(rows, "a", "b").collect()} == {("b", 1)}
    assert keyspace.rename(rows, "a", "b", only_new=True).count() == 2
    with pytest.raises(KeyError):
        keyspace.rename(rows, "zz", "b")


def test_commits_and_transactions(spark):
    changes = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "seq bigint, key string, value double")
    working = spark.createDataFrame([("a", 5.0), ("c", 3.0)], "key string, value double")
    made = {r["key"]: r["value"] for r in mutations.commit(changes, working, {1}, 2).collect()}
    assert made == {"a": 5.0, "b": None, "c": 3.0}
    with pytest.raises(ValueError, match="nothing"):
        mutations.commit(changes, mutations.view_at(changes, {1}), {1}, 2)
    view = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2)], "key string, value double, ts bigint")
    batch = spark.createDataFrame([("a", 9.0, 5), ("b", None, 6), ("n", 1.0, 7)], "key string, value double, ts bigint")
    assert mutations.apply_batch(view, batch, {"a": 7}) is None and mutations.apply_batch(view, batch, {"n": 3}) is None
    assert {r["key"]: r["value"] for r in mutations.apply_batch(view, batch, {"a": 1, "n": 0}).collect()} == {"a": 9.0, "n": 1.0}
