from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from loomstone.llm import sharding

from . import helpers


def brute(counts, owner, limit):
    """Every row by itself: own arcs first, then overflow clockwise from where it stands."""
    room, where, over = list(limit), {}, []
    for arc, n in enumerate(counts):
        for r in range(n):
            if room[owner[arc]]:
                room[owner[arc]] -= 1
                where[arc, r] = owner[arc]
            else:
                over.append((arc, r))
    queue = []
    for step in range(2 * len(counts)):
        at = step % len(counts)
        while queue and room[owner[at]]:
            where[queue.pop(0)] = owner[at]
            room[owner[at]] -= 1
        if step < len(counts):
            queue += [x for x in over if x[0] == at]
    return where


@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.data())
def test_walk_equals_row_by_row(counts, data):
    shards = data.draw(st.integers(1, 4))
    owner = data.draw(st.lists(st.integers(0, shards - 1), min_size=len(counts), max_size=len(counts)))
    for s in range(shards):  # every shard has an arc
        if s not in owner and s < len(owner):
            owner[s] = s
    if set(owner) != set(range(shards)):
        return
    limit = sharding.bounds(sum(counts), shards, 0)
    got, slots = {}, Counter()
    for arc, lo, hi, shard, slot in sharding.walk(counts, owner, limit):
        assert slot == slots[shard]
        slots[shard] += hi - lo
        got |= {(arc, r): shard for r in range(lo, hi)}
    assert got == brute(counts, owner, limit) and [slots[s] for s in range(shards)] == limit


def test_query(spark, tmp_path):
    docs = helpers.awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.op6_sharding(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    sizes = Counter(r["shard"] for r in rows)
    sizes = [sizes[s] for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(24) for k in range(sizes[s])]
    assert Counter(r["size"] for r in rows) == Counter(len((r["text"] or "").encode()) + 8 for r in docs.collect())


def test_few_rows_move_when_a_shard_is_added(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard(rows, "doc_id", n, slack=0.25).collect()} for n in (8, 9))
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a) and len(set(b.values())) == 9


def test_one_id_in_a_third_of_the_rows(spark):
    rows = spark.createDataFrame([(7,)] * 500 + [(i,) for i in range(1000)], "doc_id bigint")
    sizes = Counter(r["shard"] for r in sharding.shard(rows, "doc_id").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 1500


def test_empty_table(spark):
    assert sharding.shard(helpers.empty(spark).select("doc_id"), "doc_id").count() == 0
