"""Quality by co-training: a content view and a metadata view teach each other, then score every document together.

The content view sees the text alone: which words, word beginnings and buckets of text statistics and layout a document
has. The metadata view sees what is stated beside it: source, language and length, and pairs of these. Two heads are
trained alike: low quality, and toxic. For each head each view begins with a logistic regression on labelled rows. In
each of ROUNDS rounds either view scores all unlabelled documents; where it is CONFIDENT (calibrated on labelled rows
by models of the other folds), its label counts for the other view, whose naive Bayes weights are the counts of features by
label over all documents so labelled and the labelled rows. A view is the regression and the naive Bayes weights, blended
by a logistic regression on such held-out logits, which thus also calibrates it. In the end the two calibrated views
are weighed in the same way. A document is accepted when neither head reaches REJECT.

Only the labelled rows are bounded, by a parameter: LABELLED at most, those with the least hash of the id; features are
those that occur in them and pass CHI_SQUARE. The pool of the rounds is every unlabelled document: executors keep of
each the numbers of its features, and a round is one pass over these, of which the driver gets two counts a feature.

Nulls: a null text is empty, null metadata is a value of its own, a label row without an id or with neither label is not
used, a null label counts for the other head alone. A head whose labels are all alike (or missing) scores 0 and rejects
nothing. Several label rows of one id all count; ties of the hash of the id are ordered by id and labels. Rows that
repeat are scored each, very long texts whole. An empty table gives an empty result. Other columns, whatever their
names, are ignored by ``score`` and passed on by ``accept``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .words import U64

LABELLED = 12_000
#: Least chi-square of a feature of the content and of the metadata view.
CHI_SQUARE = (20, 4)
ROUNDS, FOLDS, CONFIDENT, REJECT = 3, 3, 0.98, 0.5
#: Documents that naive Bayes adds to each count.
SMOOTH = 1.0
HEADS, VIEWS = ("low", "toxic"), ("content", "meta")
#: Bytes of word beginnings that are features.
STEMS = (4, 5, 6)


def _tag(x: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mix(x ^ U64(kind * 0x9E3779B97F4A7C15 % (1 << 64)))


def _bucket(x: np.ndarray) -> np.ndarray:
    """Shares between 0 and 1 by steps that halve towards 0."""
    return np.clip(np.round(2 * -np.log2(np.maximum(x, 2**-8))), 0, 16).astype(np.int64)


def content(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the content view; a feature may repeat within a text."""
    w = words.scan(texts)
    raw, at = words.flat(texts)
    docs, feats = [w.doc], [_tag(w.hash, 1)]
    start = at[w.doc] + w.start if len(w.doc) else w.start
    length = w.end - w.start
    with np.errstate(over="ignore"):
        h = np.zeros(len(start), U64)
        for i in range(max(STEMS)):
            long = np.flatnonzero(length > i)
            h[long] = h[long] * U64(0x100000001B3) + words.LOWER[raw[start[long] + i]].astype(U64) + U64(1)
            if i + 1 in STEMS:
                docs.append(w.doc[long])
                feats.append(_tag(h[long], 10 + i))
    n = np.maximum(1, np.diff(at)).astype(float)
    first = w.bounds()
    n_words = np.maximum(1, np.diff(first)).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[at[1:]] - total[at[:-1]]) / n

    with np.errstate(over="ignore"):
        key = w.hash ^ words.mix(w.doc.astype(U64) + U64(1))
    _, one, count = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(w.doc[one], minlength=w.n_docs) / n_words
    most = np.zeros(w.n_docs)
    np.maximum.at(most, w.doc[one], count)
    mark = (words.LOWER[raw] == 0) & (raw > 32)
    twice = mark.copy()
    twice[1:] &= raw[1:] == raw[:-1]
    twice[:1] = False
    stats = [
        share(twice), share(mark),
        share((raw >= 65) & (raw <= 90)), share((words.LOWER[raw] == 0) & (raw > 32) & (raw != 44) & (raw != 46)), share(raw == 124), share(raw == 33),
        share((raw >= 48) & (raw <= 57)), share(raw == 10), np.minimum(1, 16 * share(raw == 10)), 1 / np.maximum(1, share(raw == 10) * n), share((raw == 44) | (raw == 46)), distinct, most / n_words, np.bincount(w.doc, length, w.n_docs) / n_words / 32,
    ]
    for k, x in enumerate(stats):
        docs.append(np.arange(w.n_docs))
        feats.append(_tag(_bucket(x).astype(U64), 100 + k))
    return np.concatenate(docs), np.concatenate(feats)


def metadata(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the metadata view: source, language, stated length, and their pairs; nothing of the text."""
    n = batch.num_rows
    stated = np.array([-1 if v is None else v for v in batch.column("n_chars").to_pylist()], float)
    one = [_tag(words.hash_words([f"x{v}".encode().hex() for v in batch.column(c).to_pylist()]), 200 + k) for k, c in enumerate(("source", "lang"))]
    one.append(_tag(np.round(2 * np.log2(np.maximum(stated, 0) + 1)).astype(np.int64).astype(U64) + (stated < 0).astype(U64) * U64(1000), 210))
    with np.errstate(over="ignore"):
        pairs = [words.mix(one[i] * U64(31) + one[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    return np.tile(np.arange(n), 6), np.concatenate([*one, *pairs])


def fit(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int, use: np.ndarray, l2: float = 3e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on the rows ``use`` of a 0/1 matrix given by its ones, by L-BFGS over the whole set."""
    number = np.full(len(y), -1, np.int32)
    number[use] = np.arange(len(use))
    keep = number[rows] >= 0
    rows, columns, y = number[rows[keep]], columns[keep], y[use].astype(float)

    def slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, w[columns], len(y)) + w[-1] if len(rows) else np.full(len(y), w[-1])
        error = sigmoid(z) - y
        loss = np.logaddexp(0, z).mean() - (y * z).mean() + l2 / 2 * (w[:-1] @ w[:-1])
        sums = np.bincount(columns, error[rows], width) if len(rows) else np.zeros(width)
        return loss, np.append(sums / len(y) + l2 * w[:-1], error.mean())

    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(width + 1)
    w[-1] = np.log(p / (1 - p))
    (loss, g), past = slope(w), []
    for _ in range(steps):
        d, shares = -g, []
        for s, t in reversed(past):
            shares.append((s @ d) / (s @ t))
            d = d - shares[-1] * t
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0
        for (s, t), share in zip(past, reversed(shares), strict=True):
            d = d + (share - (t @ d) / (s @ t)) * s
        step, down = 1.0, g @ d
        while True:
            new, new_g = slope(w + step * d)
            if new <= loss + 1e-4 * step * down or step < 1e-4:
                break
            step /= 2
        s, t = step * d, new_g - g
        w, g, gain, loss = w + s, new_g, loss - new, new
        if s @ t > 1e-12:
            past = [*past[-7:], (s, t)]
        if gain < 1e-6:
            break
    return w[:-1], float(w[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def blend(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights and offset of a logistic regression on a few dense columns, by Newton with a small ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w), -2, 2)
    return w


class Model(NamedTuple):
    """Hashes of the chosen features by view; per head the calibrated weights and bias of each view, and the views' weights."""

    chosen: tuple
    heads: tuple

    def found(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row, number of a chosen feature) by view, each once a row."""
        out = []
        for (doc, feature), chosen in zip((content(batch.column("text")), metadata(batch)), self.chosen, strict=True):
            if not len(chosen):
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            k = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
            hit = np.flatnonzero(chosen[k] == feature)
            once = np.unique(doc[hit] * len(chosen) + k[hit])
            out.append((once // len(chosen), once % len(chosen)))
        return out

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[np.ndarray]:
        out = []
        for head in self.heads:
            if head is None:
                out.append(np.zeros(n))
                continue
            views, w = head
            z = np.column_stack([logits(*view, *x, n) for view, x in zip(views, found, strict=True)])
            out.append(sigmoid(z @ w[:2] + w[2]))
        return out


def logits(weights: np.ndarray, bias: float, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights[columns], n) + bias if len(rows) else np.full(n, float(bias))


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
COMPACT = "doc_id bigint, low int, toxic int, content array<int>, meta array<int>"


def narrowed(docs: DataFrame) -> DataFrame:
    return common.filled(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("bigint").alias("n_chars"))


def compact(rows: DataFrame, chosen: tuple) -> DataFrame:
    """Of each row (doc_id, text, lang, source, n_chars, low, toxic) the labels and the numbers of its chosen features."""
    held = rows.sparkSession.sparkContext.broadcast(Model(chosen, ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(columns.astype(np.int32))) for rows, columns in held.value.found(batch)]
            yield pa.record_batch([batch.column(c) for c in ("doc_id", *HEADS)] + lists, names=["doc_id", *HEADS, *VIEWS])

    return rows.mapInArrow(run, COMPACT)


def ones(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column), dtype=np.int32), sizes), column.flatten().to_numpy(zero_copy_only=False)


def features(wide: DataFrame, scratch: common.Scratch) -> tuple:
    """Hashes of the features of the labelled rows that pass CHI_SQUARE for either head, by view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            for v, (doc, feature) in enumerate((content(batch.column("text")), metadata(batch))):
                order = np.lexsort((feature, doc))
                doc, feature = doc[order], feature[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
                row = pa.array(doc[new])
                yield pa.record_batch([pa.array(np.full(len(row), v, np.int32)), pa.array(feature[new].view(np.int64)), *(batch.column(h).take(row) for h in HEADS)], names=["view", "f", *HEADS])

    seen = wide.mapInArrow(run, "view int, f bigint, low int, toxic int")
    sums = seen.groupBy("view", "f").agg(*(F.count(h).alias(f"n_{h}") for h in HEADS), *(F.sum(h).alias(h) for h in HEADS)).where(" or ".join(f"n_{h} >= 3" for h in HEADS))
    totals = wide.agg(*(F.count(h).alias(f"n_{h}") for h in HEADS), *(F.sum(h).alias(h) for h in HEADS)).first()
    passed = F.lit(False)
    for h in HEADS:
        n, positive = totals[f"n_{h}"], totals[h] or 0
        if 0 < positive < n:
            p = positive / n
            chi = (F.coalesce(h, F.lit(0)) - F.col(f"n_{h}") * p) ** 2 / (F.col(f"n_{h}") * p * (1 - p))
            passed = passed | ((F.col(f"n_{h}") >= 3) & (chi >= F.when(F.col("view") == 0, CHI_SQUARE[0]).otherwise(CHI_SQUARE[1])))
    # Features of LABELLED rows at most, so the driver's share has a bound.
    table = scratch.table(sums.where(passed).select("view", "f"), "chosen").toArrow()
    view, f = table.column("view").to_numpy(), table.column("f").to_numpy().view(U64)
    return tuple(np.sort(f[view == v]) for v in range(2))


def train(docs: DataFrame, labels: DataFrame, scratch: common.Scratch) -> tuple[Model, DataFrame]:
    """Fit both heads on ``labels(doc_id, quality, toxic)`` and all of ``docs``; also the compact table of all docs."""
    rows = labels.where("doc_id is not null and coalesce(quality, toxic) is not null")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), (1 - F.col("quality")).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"))
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")
    sampled = rows.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "low", "toxic").limit(LABELLED)
    # The limit is a parameter, so the broadcast has a bound.
    sampled = scratch.table(sampled, "sampled")
    wide = scratch.table(narrowed(docs).join(F.broadcast(sampled), "doc_id").select(*COLUMNS, *HEADS), "labelled")
    chosen = features(wide, scratch)
    taught = compact(wide, chosen).toArrow()
    none = F.lit(None).cast("int")
    every = scratch.table(compact(narrowed(docs).select(*COLUMNS, none.alias("low"), none.alias("toxic")), chosen), "compact")
    # Without the labels and merged at every size: the plan for a small table would say nothing of a large one.
    pooled = every.select("doc_id", *VIEWS)
    there = pooled.where("doc_id is not null").join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
    pool = scratch.table(there.unionByName(pooled.where("doc_id is null")).select(*VIEWS), "pool")
    return Model(chosen, cotrain(taught, pool, chosen)), every


def cotrain(taught: pa.Table, pool: DataFrame, chosen: tuple, rounds: int = ROUNDS) -> tuple:
    """Both heads from the labelled rows and ``rounds`` passes over the pool; None for a head without both labels."""
    ids = np.array(taught.column("doc_id").to_pylist(), np.int64)
    order = np.lexsort((*(np.array([-1 if x is None else x for x in taught.column(h).to_pylist()], np.int64) for h in HEADS), ids))
    taught, ids = taught.take(pa.array(order)), ids[order]
    views = [ones(taught.column(v)) for v in VIEWS]
    fold = words.mix(ids.view(U64)) % U64(FOLDS)
    heads: list = []
    for h in HEADS:
        y = np.array([-1 if x is None else x for x in taught.column(h).to_pylist()], np.int64)
        if len(set(y[y >= 0])) < 2:
            heads.append(None)
            continue
        heads.append(Head(y, fold, views, chosen))
    for _ in range(rounds):
        live = [h for h in heads if h is not None]
        if not live:
            break
        for h, counts in zip(live, confident(pool, [h.views for h in live], chosen), strict=True):
            h.learn(counts)
    return tuple(None if h is None else (tuple(h.views), h.blended()) for h in heads)


class Head:
    """One head while it is trained: per view the regression on labelled rows, and the calibrated blend with naive Bayes.

    Blends are fitted on logits that each labelled row gets from a model of the other folds.
    """

    def __init__(self, y: np.ndarray, fold: np.ndarray, found: list, chosen: tuple):
        self.known = np.flatnonzero(y >= 0)
        self.y, self.fold, self.found, self.sizes = y, fold, found, [len(c) for c in chosen]
        self.first, self.views, self.held = [], [None, None], [None, None]
        for v in range(2):
            z = self.across(v, lambda use, v=v: fit(*found[v], y, self.sizes[v], use))
            self.first.append((*fit(*found[v], y, self.sizes[v], self.known), z))
            self.set_view(v, [self.first[v]])

    def across(self, v: int, model) -> np.ndarray:
        """Logits of all rows, those of a fold by ``model(rows of the other folds)``."""
        out = np.zeros(len(self.y))
        for f in range(FOLDS):
            use = self.known[self.fold[self.known] != f]
            if len(set(self.y[use])) < 2:
                use = self.known
            mine = self.fold == f
            out[mine] = logits(*model(use), *self.found[v], len(self.y))[mine]
        return out

    def set_view(self, v: int, parts: list[tuple[np.ndarray, float, np.ndarray]]) -> None:
        """The parts (weights, bias, logits across folds) blended so that their sum is a calibrated logit."""
        z = np.column_stack([p[2] for p in parts])
        scale = np.maximum(1.0, np.abs(z).mean(0))
        w = blend(z[self.known] / scale, self.y[self.known])
        share = w[:-1] / scale
        self.held[v] = z @ share + w[-1]
        self.views[v] = (sum(p[0] * a for p, a in zip(parts, share, strict=True)), float(sum(p[1] * a for p, a in zip(parts, share, strict=True)) + w[-1]))

    def learn(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """New views from (documents by label, features by label) that the other view's confident labels have counted."""
        for v, (n, by_feature) in enumerate(counts):

            def bayes(use: np.ndarray, v: int = v, n: np.ndarray = n, by_feature: np.ndarray = by_feature) -> tuple[np.ndarray, float]:
                rows, columns = self.found[v]
                docs, sums = n + SMOOTH, by_feature + SMOOTH / 2
                for label in (0, 1):
                    mine = np.zeros(len(self.y), bool)
                    mine[use[self.y[use] == label]] = True
                    docs[label] += mine.sum()
                    sums[label] += np.bincount(columns[mine[rows]], minlength=self.sizes[v])
                rate = sums / docs[:, None]
                odds = np.log(rate) - np.log1p(-rate)
                return odds[1] - odds[0], float((np.log1p(-rate[1]) - np.log1p(-rate[0])).sum() + np.log(docs[1] / docs[0]))

            self.set_view(v, [self.first[v], (*bayes(self.known), self.across(v, bayes))])

    def blended(self) -> np.ndarray:
        return blend(np.column_stack(self.held)[self.known], self.y[self.known])


def confident(pool: DataFrame, heads: list, chosen: tuple) -> list:
    """Per head and view, documents and features by label, over all rows of the pool where the other view is CONFIDENT."""
    sizes = [len(c) for c in chosen]
    held = pool.sparkSession.sparkContext.broadcast(heads)
    edge = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = held.value
        total = [[np.zeros((2, sizes[v] + 1), np.int64) for v in range(2)] for _ in heads]  # the last column: documents
        for batch in batches:
            found, n = [ones(batch.column(v)) for v in VIEWS], batch.num_rows
            for h, views in enumerate(heads):
                for teacher in range(2):
                    z, student = logits(*views[teacher], *found[teacher], n), 1 - teacher
                    rows, columns = found[student]
                    for label, sure in ((0, z <= -edge), (1, z >= edge)):
                        total[h][student][label, :-1] += np.bincount(columns[sure[rows]], minlength=sizes[student])
                        total[h][student][label, -1] += sure.sum()
        for h in range(len(heads)):
            for v in range(2):
                for label in (0, 1):
                    k = np.flatnonzero(total[h][v][label])
                    yield pa.record_batch([pa.array(np.full(len(k), 4 * h + 2 * v + label, np.int32)), pa.array(k.astype(np.int32)), pa.array(total[h][v][label][k])], names=["which", "k", "n"])

    table = pool.mapInArrow(run, "which int, k int, n bigint").groupBy("which", "k").agg(F.sum("n").alias("n")).toArrow()
    which, k, n = (table.column(c).to_numpy() for c in ("which", "k", "n"))
    out = []
    for h in range(len(heads)):
        per_view = []
        for v in range(2):
            sums = np.zeros((2, sizes[v] + 1))
            for label in (0, 1):
                mine = which == 4 * h + 2 * v + label
                sums[label, k[mine]] = n[mine]
            per_view.append((sums[:, -1].copy(), sums[:, :-1].copy()))
        out.append(per_view)
    return out


SCORES = "doc_id bigint, quality double, toxic double, accepted boolean"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores and verdict of every row of ``docs``."""
    none = F.lit(None).cast("int")
    return score_compact(compact(narrowed(docs).select(*COLUMNS, *(none.alias(h) for h in HEADS)), model.chosen), model)


def score_compact(every: DataFrame, model: Model) -> DataFrame:
    """Scores and verdict of every row of the compact table."""
    held = every.sparkSession.sparkContext.broadcast(model.heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, toxic = Model((), held.value).scores([ones(batch.column(v)) for v in VIEWS], batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 - low), pa.array(toxic), pa.array((low < REJECT) & (toxic < REJECT))], names=["doc_id", "quality", "toxic", "accepted"])

    return every.select("doc_id", *VIEWS).mapInArrow(run, SCORES)


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The accepted rows of ``docs``, with all their columns."""
    held, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    prefixed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(narrow for narrow in _narrow_columns()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            low, toxic = held.value.scores(held.value.found(batch), batch.num_rows)
            rows = batch.column("row").filter(pa.array((low < REJECT) & (toxic < REJECT)))
            yield pa.RecordBatch.from_arrays(rows.flatten(), names=schema.names)

    return prefixed.mapInArrow(run, schema)


def _narrow_columns() -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return [text, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("bigint").alias("n_chars")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = common.Scratch(spark)
    model, every = train(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), s)
    return s.result(score_compact(every, model), "scores")
