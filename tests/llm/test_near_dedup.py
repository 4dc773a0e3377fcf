import random

import numpy as np
import pyarrow as pa

from loomstone.llm import common, near_dedup, words

from . import helpers


def edited(text, n, seed):
    r, ws = random.Random(seed), text.split()
    for i in r.sample(range(len(ws)), n):
        ws[i] = f"edit{seed}x{i}"
    return " ".join(ws)


def jaccard(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := helpers.words(x)) else set() for x in (a, b))
    return len(s & t) / len(s | t) if s | t else 0


def classes(df, spark):
    return near_dedup.classes(df, common.Scratch(spark))


def test_family_of_edited_copies_is_one_class(spark):
    base = helpers.prose(1, 400)
    texts = [base] * 3 + [edited(base, 5, k) for k in range(40)] + [helpers.prose(100 + k, 200) for k in range(30)] + [edited(helpers.prose(7, 300), 60, k) for k in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in classes(df, spark).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in range(len(texts))}


def test_samples_agree_as_often_as_texts_are_similar():
    base = helpers.prose(3, 2000)
    idf = near_dedup.Idf(np.zeros(0, words.U64), np.zeros(0, np.int64), 100)
    texts = pa.array([base, edited(base, 40, 1)])
    near_dedup_s = near_dedup.similarities(texts.slice(0, 1), texts.slice(1, 1), idf)[0]
    assert abs(near_dedup_s - jaccard(*texts.to_pylist())) < 0.02
    agree = []
    for k in range(30):
        pair = pa.array([helpers.prose(500 + k, 600), edited(helpers.prose(500 + k, 600), 12, k)])
        _, s = near_dedup.sample(*near_dedup.weighted(words.scan(pair), idf))
        agree.append(((s[0] == s[1]).mean(), near_dedup.similarities(pair.slice(0, 1), pair.slice(1, 1), idf)[0]))
    a, b = np.mean(agree, axis=0)
    assert abs(a - b) < 0.03


def test_weighted_similarity_by_hand():
    h = words.hash_words(["a", "b", "c", "d", "e", "f"])
    idf = near_dedup.Idf(h, np.array([1, 1, 1, 1, 1, 9]), 10)
    got = near_dedup.similarities(pa.array(["a b c d e f"]), pa.array(["a b c d e"]), idf)[0]
    one, last = np.log1p(10), (4 * np.log1p(10) + np.log1p(10 / 9)) / 5  # RARE is far beyond ten documents
    assert abs(got - one / (one + last)) < 1e-6


def test_awkward_documents(spark):
    df = helpers.awkward(spark)
    got = classes(df, spark).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[0] == {0} == by[1] and by[5] == {5} == by[6] and by[7] == {7} and by[2] == {2}
    kept = near_dedup.keep(df, common.Scratch(spark))
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), *((True, k) for k in (0, 2, 3, 4, 5, 7, 8, 9, 10))]


def test_empty_table(spark):
    assert classes(helpers.empty(spark), spark).count() == 0
    assert near_dedup.keep(helpers.empty(spark), common.Scratch(spark)).count() == 0


def test_bucket_of_several_classes_in_blocks(spark, monkeypatch):
    """Every likely pair is met once, in whichever blocks its members are."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    base = helpers.prose(5, 300)
    texts = [edited(base, 2, i) for i in range(7)] + [helpers.prose(60 + i, 300) for i in range(3)]
    idf = near_dedup.Idf(np.zeros(0, words.U64), np.zeros(0, np.int64), 100)
    _, s = near_dedup.sample(*near_dedup.weighted(words.scan(pa.array(texts)), idf))
    rows = [(0, 5, i, i, len(t), bytearray((x >> words.U64(32)).astype("<u4").tobytes()), [5] + [i] * 11, t) for i, (x, t) in enumerate(zip(s, texts, strict=True))]
    df = spark.createDataFrame(rows, "band int, key bigint, v bigint, root bigint, size int, signature binary, bands array<bigint>, text string")
    found = near_dedup.likely(near_dedup.blocked(df, common.Scratch(spark)))
    assert {r["v"] for r in found.collect()} == set(range(7))
    full = found.join(df.select("v", "root", "signature", "bands", "text"), "v")
    links = {(r["a"], r["b"]) for r in near_dedup.settle(full, spark.sparkContext.broadcast(idf)).collect()}
    reached = {0}
    for _ in range(10):
        reached |= {x for p in links if set(p) & reached for x in p}
    assert reached == set(range(7))


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {x["v"]: x["root"] for x in near_dedup.components(df, common.Scratch(spark)).collect()}
    parent = {x: x for p in pairs for x in p}
    for _ in parent:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {k: v for k, v in parent.items() if k != v}


def test_frequencies_are_those_of_all_documents(spark):
    texts = [f"common w{k % 7} rare{k} common" for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    idf = near_dedup.frequencies(df, common.Scratch(spark))
    got = idf.of(words.hash_words(["common", "w0", "rare5", "never"]))
    assert np.allclose(got, np.log1p([1, 3000 / 429, near_dedup.RARE, near_dedup.RARE]), atol=1e-5)


def test_classes_of_the_given_documents_against_all_pairs(spark):
    """Brute force by the definition: counts, frequencies, weights and weighted Jaccard of every pair that shares a shingle."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: helpers.words(r["text"]) for r in docs.collect()}
    frequency = Counter(w for ws in texts.values() for w in set(ws))
    weight = {w: np.log1p(min(near_dedup.RARE, len(texts) / n)) for w, n in frequency.items()}
    sets, holders = {}, defaultdict(list)
    for d, ws in texts.items():
        grams = Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else {}
        sets[d] = {g: n * np.mean([weight[w] for w in g]) for g, n in grams.items()}
        for g in grams:
            holders[g].append(d)
    tried, similar = set(), []
    for g, who in holders.items():
        for i, a in enumerate(who):
            for b in who[:i]:
                if (a, b) in tried:
                    continue
                tried.add((a, b))
                x, y = sets[a], sets[b]
                both = sum(min(v, y[g]) for g, v in x.items() if g in y)
                if both >= near_dedup.SIMILAR * (sum(x.values()) + sum(y.values()) - both):
                    similar.append((a, b))
    got = {r["doc_id"]: r["class_id"] for r in classes(docs, spark).collect()}
    missed = [p for p in similar if got[p[0]] != got[p[1]]]
    assert len(similar) > 60 and len(missed) <= 0.01 * len(similar)
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in similar:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    wrong = [d for d in texts if sets[d] and got[d] != root(d) and not any(d in p for p in missed)]
    assert not wrong
