import random

import numpy as np

from loomstone.llm import common, quality

from . import helpers


def corpus(spark, n=900):
    r, rows, labels = random.Random(4), [], []
    for i in range(n):
        text, low, toxic = helpers.prose(i, r.randint(30, 120)), r.random() < 0.2, r.random() < 0.15
        if low:
            text = " ".join(f"{w}***" for w in text.split())
        elif toxic:
            ws = text.split()
            for _ in range(4):
                ws.insert(r.randrange(len(ws)), r.choice(["vile", "dunce", "oaf"]))
            text = " ".join(ws)
        rows.append((i, text, "en", "good" if not low or r.random() < 0.3 else "bad", len(text)))
        labels.append((i, int(not low), int(toxic and not low)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    known = spark.createDataFrame(labels[:500], "doc_id bigint, quality int, toxic int")
    model, _ = quality.train(docs, known, common.Scratch(spark))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(labels)
    held = labels[500:]
    assert np.mean([(got[i]["quality"] >= 0.5) == bool(q) for i, q, _ in held]) > 0.95
    assert np.mean([(got[i]["toxic"] >= 0.5) == bool(t) for i, _, t in held]) > 0.95
    kept = {r["doc_id"] for r in quality.accept(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["accepted"]}


def test_fit_separates():
    rows, columns = np.array([0, 0, 1, 2, 3, 3]), np.array([0, 2, 0, 1, 1, 2])
    y = np.array([1, 1, 0, 0])
    w, b = quality.fit(rows, columns, y, 3, np.arange(4))
    z = np.bincount(rows, w[columns], 4) + b
    assert ((z > 0) == (y == 1)).all()


def test_awkward_documents(spark):
    docs, labels = corpus(spark, 120)
    known = spark.createDataFrame([*labels[:80], (None, 1, 0), (5, None, 1), (6, 0, None), (7, None, None), (99999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model, _ = quality.train(docs, known, common.Scratch(spark))
    df = helpers.awkward(spark)
    assert quality.score(df, model).count() == df.count()
    kept = quality.accept(df, model)
    assert kept.columns == df.columns and kept.count() <= df.count()
    model, _ = quality.train(df, known, common.Scratch(spark))  # trained on nulls and the like
    assert quality.score(df, model).count() == df.count()


def test_no_labels_reject_nothing(spark):
    docs, labels = corpus(spark, 30)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for known in (none, spark.createDataFrame([(i, 1, 0) for i, *_ in labels], none.schema)):
        model, _ = quality.train(docs, known, common.Scratch(spark))
        assert quality.accept(docs, model).count() == 30
    assert quality.score(helpers.empty(spark), model).count() == 0
    assert quality.score(helpers.empty(spark), quality.train(helpers.empty(spark), none, common.Scratch(spark))[0]).count() == 0


def split_views(spark, n=1500):
    """A corpus whose sources tell the classes apart, and whose words do so only together; few rows are labelled."""
    r, rows, labels = random.Random(9), [], []
    bad, good = ([f"{x}{k}q" for k in range(60)] for x in ("bad", "good"))
    for i in range(n):
        low = r.random() < 0.4
        own, other = (bad, good) if low else (good, bad)
        ws = helpers.prose(i, 30).split() + [r.choice(own if r.random() < 0.68 else other) for _ in range(6)]
        r.shuffle(ws)
        rows.append((i, " ".join(ws), "en", f"{'junk' if low else 'fine'}{r.randrange(3)}", 150 + (i % 7)))
        labels.append((i, int(not low), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), labels


def test_each_view_teaches_the_other(spark, monkeypatch):
    docs, labels = split_views(spark)
    known = spark.createDataFrame(labels[:160], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(quality, "CHI_SQUARE", (0.1, 4))
    right = {}
    for rounds in (0, quality.ROUNDS):
        monkeypatch.setattr(quality.cotrain, "__defaults__", (rounds,))
        model, every = quality.train(docs, known, common.Scratch(spark))
        views, _ = model.heads[0]
        hits = []
        for row in every.where("doc_id >= 160").collect():
            z = [w[row[v]].sum() + b for (w, b), v in zip(views, quality.VIEWS, strict=True)]
            hits.append([(x >= 0) == (labels[row["doc_id"]][1] == 0) for x in z])
        right[rounds] = np.mean(hits, 0)
    content_alone, content_taught = right[0][0], right[quality.ROUNDS][0]
    assert content_taught > content_alone + 0.03  # the metadata view's labels teach words that few labelled rows have
    assert right[quality.ROUNDS][1] >= right[0][1] - 0.01


def test_confident_counts_against_all_rows(spark):
    r = np.random.default_rng(1)
    lists = [[sorted(set(r.integers(0, 9, 4).tolist())), sorted(set(r.integers(0, 5, 2).tolist()))] for _ in range(200)]
    pool = spark.createDataFrame([(i, None, None, *x) for i, x in enumerate(lists)], quality.COMPACT)
    views = [(r.normal(size=9) * 3, 0.2), (r.normal(size=5) * 4, -0.1)]
    got = quality.confident(pool, [views], (np.arange(9), np.arange(5)))[0]
    edge = np.log(quality.CONFIDENT / (1 - quality.CONFIDENT))
    for student, (docs, features) in enumerate(got):
        w, b = views[1 - student]
        z = np.array([w[x[1 - student]].sum() + b for x in lists])
        for label, sure in ((0, z <= -edge), (1, z >= edge)):
            assert docs[label] == sure.sum()
            want = np.zeros(len(features[label]))
            for k in np.flatnonzero(sure):
                want[lists[k][student]] += 1
            assert (features[label] == want).all()


def test_features_and_labels_of_every_document_count(spark):
    """No pool bound: the rounds count every unlabelled row, rows with null ids too."""
    docs, labels = corpus(spark, 200)
    known = spark.createDataFrame(labels[:90], "doc_id bigint, quality int, toxic int")
    extra = docs.limit(5).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")
    s, seen = common.Scratch(spark), []
    real = quality.cotrain
    quality.cotrain = lambda taught, pool, chosen: seen.append((taught.num_rows, pool.count())) or real(taught, pool, chosen)
    try:
        quality.train(docs.unionByName(extra), known, s)
    finally:
        quality.cotrain = real
    assert seen == [(90, 115)]


def test_the_pool_is_joined_alike_at_every_size(spark, monkeypatch):
    """A small table's join is that of a large one, and the pool has no columns but the two views."""
    docs = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'fine'} words {k}", "en", "s", 9) for k in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id bigint, quality int, toxic int")
    plans, real = {}, common.Scratch.table

    def table(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(self, df, name)

    monkeypatch.setattr(common.Scratch, "table", table)
    pools, cotrain = [], quality.cotrain
    monkeypatch.setattr(quality, "cotrain", lambda taught, pool, chosen: pools.append((pool.columns, pool.count())) or cotrain(taught, pool, chosen))
    quality.train(docs, labels, common.Scratch(spark))
    assert "SortMergeJoin" in plans["pool"] and "BroadcastHashJoin" not in plans["pool"]
    assert pools == [(list(quality.VIEWS), 20)]
