import zlib
from collections import Counter, defaultdict

import numpy as np

from loomstone.llm import common, packing, tokens

from . import helpers

PATH = tokens.public("word_bpe_49k.json")


def check(pieces, docs):
    """Every id of every document in one piece, sequences without gaps; returns pieces by document and the padding."""
    enc = tokens.encoder(PATH)
    want = Counter((r["doc_id"], zlib.crc32(x := np.array([*enc.tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()), len(x) // 4) for r in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"] > 0
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    single = {k for k, n in Counter(d for d, _, _ in want.elements()).items() if n == 1}
    for doc, crc, n in want:
        if doc in single:
            ps, at = sorted(by_doc[doc], key=lambda p: p["start"]), 0
            for p in ps:
                assert p["start"] == at and p["doc_tokens"] == n
                at += p["length"]
            assert at == n and zlib.crc32(b"".join(p["ids"] for p in ps)) == crc
    assert sum(p["length"] for p in pieces) == sum(n * c for (_, _, n), c in want.items())
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.LENGTH
    padding = sum(packing.LENGTH - n for ps in by_sequence.values() if (n := sum(p["length"] for p in ps)) & (n - 1))
    return by_doc, padding


def test_awkward_documents(spark):
    docs = helpers.awkward(spark)
    pieces = [r.asDict() for r in packing.pack(docs, PATH, common.Scratch(spark)).collect()]
    by_doc, _ = check(pieces, docs.collect())
    enc = tokens.encoder(PATH)
    for doc in (1, 7, 8):
        text = next(r["text"] for r in docs.collect() if r["doc_id"] == doc)
        ids, at = [*enc.tok.encode(text, add_special_tokens=False).ids, 2], 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert np.frombuffer(p["ids"], "<u4").tolist() == ids[at : at + p["length"]] and p["ids_crc32"] == zlib.crc32(p["ids"])
            at += p["length"]
        assert at == len(ids)


def test_many_documents_pack_tightly(spark, sf):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    pieces = [r.asDict() for r in packing.pack(docs, PATH, common.Scratch(spark)).collect()]
    _, padding = check(pieces, docs.select("doc_id", "text").collect())
    assert padding < 0.01 * sum(p["length"] for p in pieces)


def test_one_length_only(spark):
    docs = spark.createDataFrame([(i, "ka " * 1000) for i in range(50)], "doc_id bigint, text string")
    pieces = [r.asDict() for r in packing.pack(docs, PATH, common.Scratch(spark)).collect()]
    _, padding = check(pieces, docs.collect())
    assert padding < 0.02 * sum(p["length"] for p in pieces)


def histogram(seed, median, n=10_000):
    r = np.random.default_rng(seed)
    hist = np.bincount(np.maximum(1, np.exp(r.normal(np.log(median), 0.8, n)).astype(int)) % packing.LENGTH, minlength=packing.LENGTH)
    hist[0] = 0
    return hist


def test_plan_places_every_remainder_once():
    uneven = np.random.default_rng(3).integers(0, 30, packing.LENGTH)
    uneven[0] = 0
    uneven[777] = 5000  # a third of all documents have one length
    few = np.zeros(packing.LENGTH, np.int64)
    few[[5, 4095]] = 2, 1
    for hist in (uneven, histogram(1, 150, 3000), histogram(2, 2500, 3000), few, few * 0):
        p = packing.plan(hist)
        length = np.repeat(np.arange(packing.LENGTH), hist)
        rank = np.concatenate([np.arange(n) for n in hist])
        packed, sequence, offset, place = packing.locate(p, length, rank)
        ends = defaultdict(list)
        for s, o, n in zip(sequence[packed], offset[packed], length[packed], strict=True):
            ends[s].append((o, n))
        assert len(ends) == p.sequences
        line = packing.Line(p)
        for at, n in zip(place[~packed].tolist(), length[~packed].tolist(), strict=True):
            pieces = list(line.pieces(at, at + n))
            assert sum(m for m, _, _ in pieces) == n
            for m, s, o in pieces:
                ends[s].append((o, m))
        assert sum(n for x in ends.values() for _, n in x) == (hist * np.arange(packing.LENGTH)).sum()
        for x in ends.values():
            at = 0
            for o, n in sorted(x):
                assert o == at and n > 0
                at += n
            assert at <= packing.LENGTH


def test_the_solution_places_most_tokens_of_remainders():
    for hist, least in ((histogram(1, 150), 0.75), (histogram(2, 1200), 0.85), (histogram(3, 2500, 50_000), 0.85)):
        p, exact = packing.plan(hist), np.arange(packing.LENGTH)
        assert (p.taken * exact).sum() >= least * (hist * exact).sum()


def test_least_squares_against_the_truth_and_its_conditions():
    lengths, copies = packing.combinations(16)
    assert ((lengths * copies).sum(1) == 16).all()
    truth = np.zeros(len(lengths))
    truth[[3, 9, 20]] = 50, 20, 30
    r = np.random.default_rng(4)
    for counts in (np.bincount(lengths.ravel(), (copies * truth[:, None]).ravel(), 17), np.append(0, r.integers(0, 90, 16))):
        x = packing.nnls(lengths, copies, counts)
        rest = counts - np.bincount(lengths.ravel(), (copies * x[:, None]).ravel(), 17)
        slope = (copies * rest[lengths]).sum(1)  # zero where x is used, nowhere positive: the least squares
        assert (x >= 0).all() and np.abs(slope[x > 0]).max() < 1e-3 and slope.max() < 1e-2


def test_empty_table(spark):
    assert packing.pack(helpers.empty(spark), PATH, common.Scratch(spark)).count() == 0
