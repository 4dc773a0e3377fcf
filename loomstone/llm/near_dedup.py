"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document's set is its shingles of five words (one of all words where there are fewer), weighted by count in the
document times the mean inverse document frequency of the five words. Document frequencies are counted over the whole
corpus. The inverse frequency of a word is the logarithm of 1 + documents / frequency, and saturates: words in fewer than
one of RARE documents weigh as those in one of RARE do. This holds at every size, and so does the bound of the broadcast
table: at most RARE times the mean number of different words of a document are in one of RARE documents or more.

Each of SAMPLES consistent weighted samples picks a shingle and a quantised weight; two documents agree on a sample
with the probability of their weighted Jaccard similarity. BANDS bands of ROWS samples give buckets: at a similarity of
0.8 a pair shares none with a probability under 0.2 %.

Texts that are equal are one node from the start. The pivot of a bucket is its member that shares the most buckets with
others, which in a family of edited copies is their source; every other member is paired with it, which is linear in the
bucket, and the pair is verified by the exact weighted Jaccard similarity of the whole texts. Verified pairs are joined
into classes by alternating large-star and small-star steps. Where a bucket still holds several classes, its members
are compared by their signatures in blocks of BLOCK texts or BLOCK_CHARS characters; those that have a likely partner in
another class are streamed once more with their texts, block by block, and each likely pair whose ends are not yet linked
is verified, the most similar first. Only links are emitted, so what leaves a block is linear in it; memory is that of
two blocks and the longest text.

Nodes are texts, told apart by 128 bits and numbered; all that is joined and linked are numbers. What a skewed join meets
on its unique side is a written table, so that adaptive execution can split the other side's hot keys.

Nulls: a null text is empty. Documents without words form a class with equal texts only. A null doc_id is a document
like others; a class of such alone has a null class_id. Rows that repeat are members of one class. Ties: of equally
popular members of a bucket the one of the least name is its pivot. Very long texts are one row each, sampled and
compared whole. An empty table gives an empty result. Other columns, whatever their names, are ignored (``keep`` passes
them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .words import U64

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
RARE = 256
#: Share of equal samples from which two members of a bucket are verified: 5.2 standard deviations under SIMILAR.
LIKELY, BLOCK, BLOCK_CHARS = 0.5, 512, 4 << 20
SEEDS = words.mix(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _quantiles(levels: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the middles of equal steps of probability (by Newton on 1 - (1 + x) e^-x): 1/r, and ln c."""
    p = (np.arange(levels) + 0.5) / levels
    x = np.where(p < 0.5, np.sqrt(2 * p), 2 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(1e-9, x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)))
    return x.astype(np.float32), np.log(x).astype(np.float32)


R, LN_C = _quantiles()
R_INV = (1 / R).astype(np.float32)


class Idf:
    """Inverse document frequencies of the words in one of RARE documents or more, by hash; that of all others is the same."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, documents: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = np.log1p(np.minimum(RARE, documents / np.maximum(1, counts[order]))).astype(np.float32)
        self.other = np.float32(np.log1p(min(RARE, max(1, documents))))

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.other, np.float32)
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[k] == h
            out[same] = self.values[k[same]]
        return out


def frequencies(docs: DataFrame, scratch: common.Scratch) -> Idf:
    """Document frequencies over all rows of ``docs(text)``; the driver gets those of one of RARE documents or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            h, at = np.unique(h, return_inverse=True)
            return h, np.bincount(at, n).astype(np.int64)

        def rows() -> pa.RecordBatch:
            h, n = joined()
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in common.slices(batches, "text"):
            w = words.scan(batch.column("text"))
            with np.errstate(over="ignore"):
                _, first = np.unique(w.hash ^ words.mix(w.doc.astype(U64) + U64(1)), return_index=True)
            h, n = np.unique(w.hash[first], return_counts=True)
            held.append((h, n))
            size += len(h)
            if size > 1 << 20:
                held = [joined()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    counted = common.filled(docs).select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    documents = docs.count()
    known = counted.where(F.col("n") * RARE >= documents).toArrow()
    return Idf(known.column("word").to_numpy().view(U64), known.column("n").to_numpy(), documents)


def weighted(w: words.Words, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of the distinct shingles of each text, by text."""
    h, at = words.grams(w, SHINGLE)
    doc = w.doc[at]
    total = np.concatenate([[0], np.cumsum(idf.of(w.hash), dtype=np.float64)])
    mean = (total[at + SHINGLE] - total[at]) / SHINGLE
    first = w.bounds()
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    if len(short):
        sh = np.zeros(len(short), U64)
        with np.errstate(over="ignore"):
            for i, d in enumerate(short):
                for x in w.hash[first[d] : first[d + 1]]:
                    sh[i] = sh[i] * U64(0xD6E8FEB86659FD93) + x
        h, doc = np.concatenate([h, words.mix(sh)]), np.concatenate([doc, short])
        mean = np.concatenate([mean, (total[first[short + 1]] - total[first[short]]) / np.diff(first)[short]])
    with np.errstate(over="ignore"):
        key = h ^ words.mix(doc.astype(U64) + U64(1))
    _, one, tf = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(doc[one], kind="stable")
    one, tf = one[order], tf[order]
    return doc[one], h[one], (mean[one] * tf).astype(np.float32)


def sample(doc: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their SAMPLES consistent weighted samples as 64-bit numbers)."""
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    out = np.empty((len(starts), SAMPLES), U64)
    if not len(starts):
        return doc, out
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(doc)]))
    ln_w = np.log(np.maximum(weight, np.float32(1e-6)))
    with np.errstate(over="ignore"):
        for i in range(SAMPLES):
            x = (h ^ SEEDS[i]) * U64(0xBF58476D1CE4E5B9)
            x ^= x >> U64(29)
            x *= U64(0x94D049BB133111EB)
            part = x.view(np.uint16).reshape(-1, 4)
            a, beta = part[:, 3], part[:, 2].astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(ln_w * R_INV[a] + beta)
            score = LN_C[part[:, 1]] - R[a] * (t - beta + 1)
            least = np.minimum.reduceat(score, starts)
            hit = np.flatnonzero(score == least[group])
            where = np.searchsorted(hit, starts)  # a text's first hit
            one = hit[where]
            out[:, i] = words.mix(h[one] + t[one].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))
    return doc[starts], out


SIGNED = "doc_id bigint, k binary, bands array<bigint>, signature binary, size int"


def signed(docs: DataFrame, idf) -> DataFrame:
    """doc_id, name of the text, band keys, signature (32 bits a sample); nulls for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = idf.value
        for batch in common.slices(batches, "text"):
            which, s = sample(*weighted(words.scan(batch.column("text")), held))
            bands: list = [None] * batch.num_rows
            marks: list = [None] * batch.num_rows
            with np.errstate(over="ignore"):
                keys = np.zeros((len(which), BANDS), U64)
                for r in range(ROWS):
                    keys = words.mix(keys * U64(31) + s[:, r::ROWS])
                keys ^= words.mix(np.arange(BANDS, dtype=U64))
            for d, b, m in zip(which.tolist(), keys.view(np.int64), (s >> U64(32)).astype("<u4"), strict=True):
                bands[d], marks[d] = b, m.tobytes()
            yield pa.record_batch([batch.column("doc_id"), batch.column("k"), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pc.binary_length(batch.column("text")).cast(pa.int32())], names=["doc_id", "k", "bands", "signature", "size"])

    return named(docs).mapInArrow(run, SIGNED)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's name (its 128-bit digest)."""
    return common.filled(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("k"))


def similarities(a: pa.Array, b: pa.Array, idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of the texts pair by pair."""
    (pa_, ha, wa), (pb, hb, wb) = (weighted(words.scan(x), idf) for x in (a, b))
    with np.errstate(over="ignore"):
        ka, kb = (h ^ words.mix(p.astype(U64) + U64(1)) for h, p in ((ha, pa_), (hb, pb)))
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    n = len(a)
    both = np.bincount(pa_[ia], np.minimum(wa[ia], wb[ib]), n)
    total = np.bincount(pa_, wa, n) + np.bincount(pb, wb, n) - both
    return both / np.maximum(total, 1e-12)


def verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose texts are SIMILAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = idf.value
        for big in common.slices(batches, "x"):
            for batch in common.slices(iter([big]), "y"):
                s = similarities(batch.column("x"), batch.column("y"), held)
                yield batch.select(["a", "b"]).filter(pa.array(s >= SIMILAR - 1e-6))

    joined = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


GROUP = ["band", "key", "i", "j"]


def blocked(members: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Members (band, key, v, size, ...) by blocks of their bucket: with more than one, a member meets every other block in a group of two."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_CHARS, F.lit(1))).cast("int")
    size = scratch.table(members.groupBy("band", "key").agg(blocks.alias("blocks")), "blocks")
    rows = members.join(size, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(band, key, i, j) and the rows of each group of sorted batches."""
    last, rows = None, []
    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True)
        for name, *row in zip(names, *(batch.column(c).to_pylist() for c in columns), strict=True):
            if name != last:
                if rows:
                    yield last, rows
                last, rows = name, []
            rows.append(row)
    if rows:
        yield last, rows


class Block:
    """Signatures of a group's members; ``partners(u)`` are the likely ones after u, the most similar first."""

    def __init__(self, name: tuple, own: list[int], signatures: list[bytes], bands: list[list[int]]):
        self.band, self.same_block = name[0], name[2] == name[3]
        self.own, self.bands = np.array(own), np.array(bands)
        self.s = np.frombuffer(b"".join(signatures), "<u4").reshape(-1, SAMPLES)

    def partners(self, u: int) -> np.ndarray:
        same = (self.s[u + 1 :] == self.s[u]).sum(1)
        ok = same >= LIKELY * SAMPLES
        if not self.same_block:
            ok &= self.own[u + 1 :] != self.own[u]
        at = np.flatnonzero(ok)
        # A pair belongs to the first band that it shares.
        at = at[(self.bands[u + 1 + at] == self.bands[u]).argmax(1) == self.band]
        return u + 1 + at[np.argsort(-same[at], kind="stable")]


def likely(members: DataFrame) -> DataFrame:
    """Members (band, key, i, j, own, v) of blocked ones that have a likely partner of another class in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in groups(batches, ["own", "v", "root", "signature", "bands"]):
            own, v, root, signature, bands = zip(*rows, strict=True)
            if len(set(root)) == 1:
                continue
            block, hit = Block(name, own, signature, bands), np.zeros(len(rows), bool)
            classes = np.array(root)
            for u in range(len(rows)):
                other = block.partners(u)
                other = other[classes[other] != classes[u]]
                hit[other] = True
                hit[u] |= len(other) > 0
            n = int(hit.sum())
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.record_batch([*(pa.array([x] * n, t) for x, t in zip(name, kinds, strict=True)), pa.array(np.array(own)[hit], pa.int32()), pa.array(np.array(v)[hit])], names=[*GROUP, "own", "v"])

    rows = members.repartition(*GROUP).sortWithinPartitions(*GROUP, "v").select(*GROUP, "own", "v", "root", "signature", "bands")
    return rows.mapInArrow(run, "band int, key bigint, i int, j int, own int, v bigint")


def settle(members: DataFrame, idf) -> DataFrame:
    """Links (a, b) between members (band, key, i, j, own, v, root, signature, bands, text) of one group, none that others imply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = idf.value
        for name, rows in groups(batches, ["own", "v", "root", "signature", "bands", "text"]):
            own, k, root, signature, bands, text = zip(*rows, strict=True)
            block, features, parent, found = Block(name, own, signature, bands), {}, list(range(len(rows))), []
            first: dict[int, int] = {}
            for u, r in enumerate(root):
                parent[u] = first.setdefault(r, u)

            def top(u: int, parent: list[int] = parent) -> int:
                while parent[u] != u:
                    parent[u] = parent[parent[u]]
                    u = parent[u]
                return u

            def feature(u: int, features: dict = features, text: tuple = text) -> tuple[np.ndarray, np.ndarray, float]:
                if u not in features:
                    _, h, w = weighted(words.scan(pa.array([text[u]])), held)
                    order = np.argsort(h)
                    features[u] = h[order], w[order], float(w.sum())
                return features[u]

            for u in range(len(rows)):
                for v in block.partners(u).tolist():
                    if top(u) == top(v):
                        continue
                    (ha, wa, ta), (hb, wb, tb) = feature(u), feature(v)
                    if min(ta, tb) < (SIMILAR - 1e-6) * max(ta, tb):
                        continue
                    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
                    hit = hb[at] == ha
                    both = float(np.minimum(wa[hit], wb[at[hit]]).sum())
                    if both >= (SIMILAR - 1e-6) * (ta + tb - both):
                        found.append((max(k[u], k[v]), min(k[u], k[v])))
                        parent[max(top(u), top(v))] = min(top(u), top(v))
            yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    rows = members.repartition(*GROUP).sortWithinPartitions(*GROUP, "v").select(*GROUP, "own", "v", "root", "signature", "bands", "text")
    return rows.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(v, root): for each end of an edge (a, b) the least number it is linked to."""
    edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Each node's neighbours (large: greater ones; small: lesser ones and itself) linked to the least around it."""
        if large:
            e = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        around = e.join(least, "u")
        if large:
            return around.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        moved = around.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())

    before = None
    while (now := state(edges)) != before:
        before = now
        edges = scratch.table(star(scratch.table(star(edges, True), "edges"), False), "edges")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))


def classes(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """doc_id, k (name of the text) and class_id, the least doc_id of the class, for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(frequencies(docs, scratch))
    rows = scratch.table(signed(docs, idf), "signed")
    nodes = rows.groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("size").alias("size"))
    nodes = scratch.table(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")
    members = nodes.where("bands is not null").select("v", F.posexplode("bands").alias("band", "key"))
    sizes = scratch.table(members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    # How many buckets' members a text meets; a text's buckets come together for that.
    popular = members.join(sizes, ["band", "key"]).groupBy("v").agg(F.sum("n").alias("p"), F.collect_list(F.struct("band", "key")).alias("b"))
    members = scratch.table(popular.select("v", "p", F.explode("b").alias("b")).select("v", "p", "b.*"), "members")
    pivots = members.groupBy("band", "key").agg(F.min(F.struct((-F.col("p")).alias("p"), F.col("v").alias("pivot"))).alias("m")).select("band", "key", "m.pivot")
    pairs = members.join(scratch.table(pivots, "pivots"), ["band", "key"]).where("v <> pivot")
    tried = scratch.table(pairs.select(F.greatest("v", "pivot").alias("a"), F.least("v", "pivot").alias("b")).distinct(), "pairs")
    wanted = members.select("v").distinct().join(nodes.select("v", F.col("k").alias("k0"), "rep"), "v")
    texts = named(docs).join(wanted, (F.col("k0") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("v", "text").dropDuplicates(["v"])
    texts = scratch.table(texts, "texts")
    links = scratch.table(verify(tried, texts, idf), "links")
    roots = components(links, scratch)
    held = members.select("band", "key", "v").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    held = scratch.table(held, "held")
    mixed = held.groupBy("band", "key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band", "key")
    marks = nodes.select("v", "signature", "bands", "size")
    open_ = held.join(scratch.table(mixed, "mixed"), ["band", "key"]).join(marks, "v")
    found = scratch.table(likely(blocked(open_, scratch)), "likely")
    if not found.isEmpty():
        full = found.join(held.select("v", "root").distinct(), "v").join(marks.drop("size"), "v").join(texts, "v")
        links = scratch.table(links.unionByName(settle(full, idf)), "links")
        roots = components(links, scratch)
    owned = scratch.table(nodes.select("k", "rep", "v").join(roots, "v", "left").select("k", "rep", F.coalesce("root", "v").alias("root")), "owned")
    least = scratch.table(owned.groupBy("root").agg(F.min("rep").alias("class_id")), "least")
    named_classes = scratch.table(owned.join(least, "root").select("k", "class_id"), "named")
    return rows.select("doc_id", "k").join(named_classes, "k")


def keep(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The rows of ``docs`` with one row of each class, that of the least doc_id; of the scratch tables one small one stays."""
    found = scratch.table(classes(docs, scratch), "classes")
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("k").alias("_k"), F.count("*").alias("_n")).withColumnRenamed("class_id", "_id")
    chosen = scratch.table(chosen, "chosen")
    name = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # The row travels as one struct, so no name of its columns can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("_doc"), name.alias("_name"))
    rows = rows.join(chosen.drop("_n"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_name") == F.col("_k")), "left_semi")
    twice = not chosen.where("_n > 1").isEmpty()
    scratch.drop(keep=1)
    if twice:  # some chosen row may stand more than once
        rows = rows.dropDuplicates(["_doc", "_name"])
    return rows.select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = common.Scratch(spark)
    return s.result(classes(common.read(spark, sf_dir, "documents"), s).select("doc_id", "class_id"), "near")
