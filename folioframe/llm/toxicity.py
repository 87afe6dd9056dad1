"""Toxicity by a classifier chain of linear models.

Categories are label columns in a fixed order. The model of a category sees the presence of selected loose words and
word beginnings (A-Z folded), a few ratios of the text, and the probabilities of all earlier categories. Models are trained on
out-of-fold probabilities of the earlier ones: each training row's were made by a model that had not seen it. When
scoring, the probabilities of the final earlier models take their place. A category's decision threshold is the one of
best F1 on its out-of-fold probabilities.

Training takes all labelled documents up to MAX_TRAIN. Of more, each combination of labels gives an equal share, and all
it has where that is less (so that rare positives stay), by the smallest hashes of doc_id; a document then weighs as many
as it stands for, in the models' fit, base rates and thresholds. Words are selected in each fold by their chi-square
against the label: executors count them by ranges of hashes, and only those that some fold selects go to the driver.
Scoring covers whole texts in
one pass without a shuffle.

Cases: null or empty text has no words and is scored by its ratios; rows with a null label are not trained on; of
several labels for a doc_id the largest holds; labels without a document are ignored, several documents of one doc_id
all train. Where a category has fewer than MIN_CLASS examples of either class, its probability is its base rate (0
without labels) and nothing is decided positive. Extra columns of documents pass through `keep`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.kernels import LOOSE, Words, lookup, mix, slices, text_bytes
from folioframe.llm.runtime import persisted

MAX_TRAIN = 16000
FOLDS = 5
SELECTED = 128
MIN_SUPPORT = 5
MIN_CLASS = 10
MIN_CHI = 10.83
#: Ranges of feature hashes, counted one at a time.
RANGES = 64
RIDGE = 1.0
N_DENSE = 5
#: Bytes of the word beginnings that are features, besides whole words (0).
PREFIXES = (0, 4, 5, 6)
#: A feature is the high half of its hash, so that the training rows stay small.
HIGH = np.uint64(0xFFFFFFFF00000000)


def word_features(words: Words) -> list[np.ndarray]:
    """For each kind of feature the hash at every word: the word, and its first bytes, which catch stems."""
    tags = [mix(np.array([k], np.uint64))[0] for k in range(len(PREFIXES))]
    return [(h ^ tag) & HIGH for h, tag in zip(words.prefix_hashes(PREFIXES, fold=True), tags, strict=True)]


def ratios(words: Words) -> np.ndarray:
    """Dense values of each text."""
    data, offsets = words.data, words.offsets
    n_words, n_bytes = np.diff(words.first), np.diff(offsets)
    some_w, some_b = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    marks = np.concatenate([[0], np.cumsum(LOOSE[data])])
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    spaces = np.concatenate([[0], np.cumsum(data == 32)])
    counts = [(x[offsets[1:]] - x[offsets[:-1]]) / some_b for x in (marks, digits, spaces)]
    return np.stack([np.log1p(n_words), *counts, np.minimum(n_bytes / some_w, 50)], axis=1)


def distinct(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, hash), sorted."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def featurise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text (text number, hash; sorted) and dense values."""
    words = Words(data, offsets, LOOSE)
    found = word_features(words)
    d, h = distinct(np.tile(words.docs(), len(found)), np.concatenate(found))
    return d, h, ratios(words)


@dataclass
class Linear:
    """words (sorted hashes) present, then dense values as (x - centre) / scale, then earlier log-odds."""

    words: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float | None = None

    def probability(self, d: np.ndarray, h: np.ndarray, dense: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        n = len(dense)
        if self.base is not None:
            return np.full(n, self.base)
        w, k = self.weights, len(self.words)
        z = np.full(n, w[-1])
        if k and len(h):
            p = np.minimum(np.searchsorted(self.words, h), k - 1)
            hit = self.words[p] == h
            z += np.bincount(d[hit], weights=w[p[hit]], minlength=n)
        z += np.clip((dense - self.centre) / self.scale, -4, 4) @ w[k : k + N_DENSE]
        if earlier.shape[1]:
            z += earlier @ w[k + N_DENSE : -1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def chi_square(both: np.ndarray, ones: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Of features in `both` of n documents and `ones` of the pos positive ones; 0 for those in too few."""
    expect = both * pos / n
    chi = (ones - expect) ** 2 / np.maximum(expect * (1 - pos / n) * (1 - both / n), 1e-9)
    chi[both < MIN_SUPPORT] = 0
    return chi


def fit_linear(d: np.ndarray, code: np.ndarray, vocab: np.ndarray, dense: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Linear:
    """code: the place in `vocab` (sorted hashes) of the word of each (document d, word)."""
    n, pos = len(y), int(y.sum())
    none = np.zeros(0)
    if min(pos, n - pos) < MIN_CLASS:
        return Linear(none.astype(np.uint64), none, none, none, float(weight @ y / weight.sum()) if n else 0.0)
    both = np.bincount(code, minlength=len(vocab))
    ones = np.bincount(code, weights=y[d], minlength=len(vocab))
    chi = chi_square(both, ones, n, pos)
    best = np.argsort(-chi, kind="stable")[:SELECTED]
    best = np.sort(best[chi[best] > MIN_CHI])
    place = np.full(len(vocab), -1)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best) + N_DENSE + earlier.shape[1] + 1))
    keep = place[code] >= 0
    x[d[keep], place[code[keep]]] = 1
    centre, scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    x[:, len(best) : len(best) + N_DENSE] = np.clip((dense - centre) / scale, -4, 4)
    if earlier.shape[1]:
        x[:, len(best) + N_DENSE : -1] = earlier
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    w[-1] = np.log((weight @ y) / (weight @ (1 - y)))
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge @ w**2 / 2)

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), grad)
        # A whole step may overshoot where one class is rare.
        while (new := loss(w - step)) > now and np.abs(step).max() >= 1e-6:
            step /= 2
        w, now = w - step, new
        if np.abs(step).max() < 1e-6:
            break
    return Linear(vocab[best], centre, scale, w)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability of best F1, half-way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((weight * y)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + max(1, weight @ y))
    cut = np.flatnonzero(np.diff(p[order], append=-1.0) < 0)
    k = cut[np.argmax(f1[cut])]
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]
    out_of_fold: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of each text and category. Only features that some model uses are made distinct."""
        words = Words(data, offsets, LOOSE)
        used = np.unique(np.concatenate([m.words for m in self.models]))
        docs, dense = words.docs(), ratios(words)
        hits = [(docs[k], h[k]) for h in word_features(words) for k in (lookup(h, used) >= 0,)]
        d, h = distinct(np.concatenate([a for a, _ in hits]), np.concatenate([b for _, b in hits]))
        p = np.zeros((len(dense), len(self.models)))
        for k, model in enumerate(self.models):
            p[:, k] = model.probability(d, h, dense, log_odds(p[:, :k]))
        return p


def fit_chain(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], categories: list[str], weights: np.ndarray | None = None) -> Chain:
    """docs: (high halves of the sorted distinct feature hashes, dense values, labels, fold) of each training document."""
    n = len(docs)
    weight = np.ones(n) if weights is None else weights
    # Features of the same high bits are counted together, which leaves out most of the rare ones before they are sorted.
    crowd = np.zeros(1 << 22, np.int32)
    for words, *_ in docs:
        crowd[words >> np.uint32(10)] += 1
    docs = [(words[crowd[words >> np.uint32(10)] >= MIN_SUPPORT], *rest) for words, *rest in docs]
    lens = np.array([len(x[0]) for x in docs], np.int64)
    d = np.repeat(np.arange(n, dtype=np.int32), lens)
    vocab, code = np.unique(np.concatenate([x[0] for x in docs]) if n else np.zeros(0, np.uint32), return_inverse=True)
    vocab, code = vocab.astype(np.uint64) << np.uint64(32), code.astype(np.int32)
    # What too few documents have, no fold selects.
    often = np.bincount(code, minlength=len(vocab)) >= MIN_SUPPORT
    keep = often[code]
    d, code, vocab = d[keep], (np.cumsum(often) - 1)[code[keep]], vocab[often]
    dense = np.array([x[1] for x in docs]).reshape(n, N_DENSE)
    y = np.array([x[2] for x in docs], float).reshape(n, len(categories))
    fold = np.array([x[3] for x in docs], int)
    held, models, thresholds = np.zeros_like(y), [], []
    for k in range(len(categories)):
        earlier = log_odds(held[:, :k])
        for f in range(FOLDS):
            rest, part = fold != f, fold == f
            a, b = np.cumsum(rest) - 1, np.cumsum(part) - 1
            on, off = rest[d], part[d]
            m = fit_linear(a[d[on]], code[on], vocab, dense[rest], earlier[rest], y[rest, k], weight[rest])
            held[part, k] = m.probability(b[d[off]], vocab[code[off]], dense[part], earlier[part])
        models.append(fit_linear(d, code, vocab, dense, earlier, y[:, k], weight))
        thresholds.append(best_threshold(held[:, k], y[:, k], weight) if models[-1].base is None else 2.0)
    return Chain(categories, models, thresholds, held)


def allotted(sizes: list[int], total: int) -> list[int]:
    """`total` dealt out evenly, but no more to each than its size."""
    out, left = [0] * len(sizes), total
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - k))
        left -= out[i]
    return out


def drawn(known: DataFrame, categories: list[str], max_train: int) -> DataFrame:
    """Labels of at most max_train documents, and how many each stands for, as weight."""
    groups = sorted(known.groupBy(*categories).agg(F.count("*").alias("__n")).collect())
    result = known.limit(0).withColumn("weight", F.lit(1.0))
    for r, n in zip(groups, allotted([r["__n"] for r in groups], max_train), strict=True):
        if n:
            part = known.where(" AND ".join(f"`{c}` = {r[c]}" for c in categories))
            part = part if n == r["__n"] else part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
            result = result.unionByName(part.withColumn("weight", F.lit(r["__n"] / n)))
    return result


def selected(rows: DataFrame, categories: list[str]) -> np.ndarray:
    """The high halves (sorted) of the features that a fold's model or the final one selects."""
    totals = {}
    for r in rows.groupBy("y", F.pmod("fold", F.lit(FOLDS)).alias("part")).count().collect():
        totals[tuple(r.y), r.part] = r["count"]
    combos = sorted({y for y, _ in totals})
    place = {y: i for i, y in enumerate(combos)}
    size = np.zeros((FOLDS, len(combos)), np.int64)
    for (y, part), n in totals.items():
        size[part, place[y]] = n
    positive = np.array(combos, bool).reshape(len(combos), len(categories))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w, np.uint32) for w in batch.column(2).to_pylist()]
            code = [f % FOLDS * len(combos) + place[tuple(y.values())] for f, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            h, code = np.concatenate(words), np.repeat(np.array(code, np.int32), [len(w) for w in words])
            order = np.argsort(h, kind="stable")
            h, code = h[order], code[order]
            cut = np.searchsorted(h.astype(np.int64), np.arange(RANGES + 1) * (2**32 // RANGES))
            load = [(i, h[cut[i] : cut[i + 1]].tobytes(), code[cut[i] : cut[i + 1]].tobytes()) for i in range(RANGES) if cut[i] < cut[i + 1]]
            cols = list(zip(*load, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dst", "words", "codes"])

    def choose(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("words").to_pylist()])
        code = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("codes").to_pylist()])
        vocab, at = np.unique(h, return_inverse=True)
        often = np.bincount(at, minlength=len(vocab)) >= MIN_SUPPORT
        keep = often[at]
        vocab, at, code = vocab[often], (np.cumsum(often) - 1)[at[keep]], code[keep]
        held = np.bincount(at * size.size + code, minlength=len(vocab) * size.size).reshape(len(vocab), *size.shape)
        out: list[list[np.ndarray]] = [[], [], []]
        for fold in range(FOLDS + 1):
            there = np.arange(FOLDS) != fold
            n, both = int(size[there].sum()), held[:, there].sum(axis=(1, 2))
            for k in range(len(categories)):
                pos = int(size[there][:, positive[:, k]].sum())
                if min(pos, n - pos) >= MIN_CLASS:
                    chi = chi_square(both, held[:, there][:, :, positive[:, k]].sum(axis=(1, 2)), n, pos)
                    best = np.argsort(-chi, kind="stable")[:SELECTED]
                    best = best[chi[best] > MIN_CHI]
                    for c, v in zip(out, (np.full(len(best), fold * len(categories) + k), chi[best], vocab[best].astype(np.int64)), strict=True):
                        c.append(v)
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, (pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["model", "chi", "word"])

    sent = rows.select("fold", "y", "words").mapInArrow(send, "dst int, words binary, codes binary")
    best: dict[int, list[tuple[float, int]]] = {}
    for r in sent.groupBy("dst").applyInArrow(lambda t: choose(t), "model int, chi double, word bigint").collect():
        best.setdefault(r.model, []).append((-r.chi, r.word))
    return np.array(sorted({w for x in best.values() for _, w in sorted(x)[:SELECTED]}), np.uint32)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_train: int = MAX_TRAIN) -> Chain:
    """`labels`: doc_id and the category columns (0/1). The labelled sample is bounded, so it may be broadcast."""
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    known = persisted(known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]), "labels")
    sample = drawn(known, categories, max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id").alias("fold"), F.struct(*categories).alias("y"), "text", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets):
                d, h, dense = featurise(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = np.searchsorted(d, np.arange(j - i + 1))
                h = (h >> np.uint64(32)).astype(np.uint32)
                words = [h[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)]
                digest = [hashlib.blake2b(w, digest_size=16).digest() for w in words]
                cols = [batch.column(c).slice(i, j - i) for c in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(digest, pa.binary()), pa.array(words, pa.binary()), pa.array([x.tobytes() for x in dense], pa.binary())], names=["fold", "y", "weight", "digest", "words", "dense"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w, np.uint32) for w in batch.column(3).to_pylist()]
            words = [w[lookup(w.astype(np.uint64), used.astype(np.uint64)) >= 0].tobytes() if len(w) and len(used) else b"" for w in words]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(words, pa.binary()), batch.column(4), batch.column(5)], names=batch.schema.names)

    y_type = f"struct<{', '.join(f'{c}: int' for c in categories)}>"
    found = rows.mapInArrow(run, f"fold bigint, y {y_type}, weight double, digest binary, words binary, dense binary")
    # Copies of one text tell no more than one of them.
    once = found.groupBy("digest", "y").agg(F.min(F.struct("fold", "dense")).alias("least"), F.first("weight").alias("weight"), F.first("words").alias("words"))
    once = persisted(once.select("least.fold", "y", "weight", "words", "least.dense", "digest"), "features")
    used = selected(once, categories)
    got = once.mapInArrow(narrow, once.schema).collect()
    got = sorted(got, key=lambda r: (r.fold, bytes(r.digest), tuple(r.y)))
    return fit_chain([(np.frombuffer(r.words, np.uint32), np.frombuffer(r.dense), np.array(r.y), r.fold % FOLDS) for r in got], categories, np.array([r.weight for r in got]))


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, then for each category p_<category> and the decision <category>."""
    keep = list(keep)
    schema = T.StructType([docs.schema[c] for c in keep])
    for c in chain.categories:
        schema.add(f"p_{c}", T.DoubleType()).add(c, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for i, j in slices(offsets):
                p = chain.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                for k, least in enumerate(chain.thresholds):
                    out += [pa.array(p[:, k]), pa.array(p[:, k] >= least)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    place = keep.index(text) if text in keep else len(keep)
    sent = keep if text in keep else [*keep, text]
    return docs.select(*[docs[c] for c in sent]).mapInArrow(run, schema)
