import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from loomstone.llm import decontamination as dc
from loomstone.llm import words

from . import helpers


def brute(texts, items, window):
    wins = {}
    for name, text in items:
        ws = helpers.words(text)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1) if ws else ():
            wins.setdefault(tuple(ws[k : k + n]), set()).add(name)
    out = []
    for t in texts:
        ws, hit, found = helpers.words(t), set(), set()
        for n in {len(w) for w in wins}:
            for k in range(len(ws) - n + 1):
                if (who := wins.get(tuple(ws[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= who
        out.append((len(ws), sorted(hit), sorted(found)))
    return out


TEXT = st.lists(st.sampled_from(["a", "b", "c", "A", "zz", "é"]), max_size=25).map(" ".join)


@settings(max_examples=300)
@given(st.lists(TEXT, max_size=5), st.lists(TEXT, max_size=5), st.integers(1, 5))
def test_automaton_against_all_windows(texts, items, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    a = dc.Automaton([(n, dc.split(t)) for n, t in named], window)
    w = words.scan(pa.array(texts, pa.string()))
    got = {d: (m, sorted(i)) for d, m, i in a.hits(w, [t.encode() for t in texts])}
    for d, (_, hit, found) in enumerate(brute(texts, named, window)):
        assert got.get(d, ([], [])) == (hit, found)


def _tables(spark):
    item, short = helpers.prose(50, 30), "Unusual Words"
    docs = helpers.awkward(spark).collect()
    extra = [(100, f"{helpers.prose(51, 40)} {item} {helpers.prose(52, 40)}"), (101, "say unusual, words! now"), (102, " ".join(item.split()[:12])), (102, f"x {item}")]
    rows = [tuple(r) for r in docs] + [(i, t, "en", "s", len(t), "k", "r", 1, 2, "h", 3) for i, t in extra]
    items = [(1, item), (2, short), (3, None), (4, "..."), (None, item), (5, helpers.prose(53, 40))]
    return spark.createDataFrame(rows, helpers.SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), rows, items


def test_report_in_one_and_many_blocks(spark):
    docs, items, rows, raw = _tables(spark)
    named = [("null" if i is None else str(i), t) for i, t in raw]
    want = sorted(((r[0] is not None, r[0] or 0), n, len(h), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(h) and 20 * len(h) >= n) for r, (n, h, f) in zip(rows, brute([r[1] for r in rows], named, dc.WINDOW), strict=True))
    for block in (dc.BLOCK_WORDS, 35):
        got = dc.report(dc.find(docs, items, block_words=block)).collect()
        assert sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in got) == want


def test_clean_cuts_spans_and_leaves_the_rest(spark):
    docs, items, rows, _ = _tables(spark)
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns
    by_id = {r["doc_id"]: r for r in kept.collect()}
    before = {r[0]: r[1] for r in rows}
    assert by_id[100]["text"] == f"{helpers.prose(51, 40)}  {helpers.prose(52, 40)}" and by_id[100]["n_chars"] == len(by_id[100]["text"])
    assert by_id[101]["text"] == "say ! now" and before[101] != by_id[101]["text"]
    assert by_id[7]["text"] == before[7] and by_id[0]["text"] is None
    assert kept.where("doc_id = 102").count() == 1  # the row that was item for the most part went


def test_empty_tables(spark):
    docs, items, rows, _ = _tables(spark)
    assert dc.find(helpers.empty(spark), items).count() == 0
    assert dc.report(dc.find(docs, items.limit(0))).where("n_hit > 0 or contaminated").count() == 0
    assert dc.clean(docs, items.limit(0)).count() == len(rows)


def test_clean_does_not_depend_on_blocks(spark):
    b = helpers.prose(60, 26).split()
    x, y = helpers.prose(61, 30), helpers.prose(62, 30)
    items = spark.createDataFrame([(1, " ".join(b[6:19])), (2, " ".join(b)), (3, x), (4, y)], "item_id bigint, text string")
    texts = [f"{helpers.prose(63, 60)} {' '.join(b)} {helpers.prose(64, 60)}", f"{x} {helpers.prose(65, 40)} {y}", f"{' '.join(b[:6])} {x} {' '.join(b[6:])} {helpers.prose(66, 90)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    one, many = ({r["doc_id"]: r["text"] for r in dc.clean(docs, items, block_words=n).collect()} for n in (dc.BLOCK_WORDS, 14))
    assert one == many and set(one) == {0, 2} and not set(b) & set(one[0].split()) - set(helpers.prose(63, 60).split()) - set(helpers.prose(64, 60).split())


def test_clean_takes_one_worker_a_task_however_many_blocks(spark):
    docs, items, _, _ = _tables(spark)
    for block in (dc.BLOCK_WORDS, 35):
        plan = dc.clean(docs, items, block_words=block)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
