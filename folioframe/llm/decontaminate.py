"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Words are runs of letters, digits and non-ASCII bytes, A-Z folded. A document leaks an item of L words where some run
of its words has an edit distance of at most k = floor(MAX_EDITS * L) words to the item.

1. Seeds: an item is cut into k + 1 pieces. Any leak leaves one of them intact, so positions where no piece occurs
   need no window (this step loses nothing).
2. Windows of L words around each seed's diagonal, at up to seven shifts of k words or less, are embedded by a CGK walk, whose steps
   output the current word and move on by a random bit of (step, word), which maps edit distance to Hamming distance.
   A window and the item are candidates if, under one of R walks, m sampled outputs agree. R comes from the match rate
   measured on random items at the full distance k.
3. Candidates are verified by the exact edit distance between the item and the best run of words around the window. So
   are the seeds that the walks leave undecided, unless more than k of the item's words occur nowhere around them, which
   no leak has. The walks miss edits that all shift one way more often than mixed ones; this step makes up for it, so
   that every leak is found.

Items are the stated query set: they are read in blocks of ITEM_BLOCK and each block scans the documents once, without
a shuffle. Cases: null, empty or wordless texts neither leak nor are leaked; repeated documents and items are reported
each for itself; extra columns are ignored; an item of under 1 / MAX_EDITS words must occur word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioframe.llm.kernels import LOOSE, Words, grams, lookup, mix, slices, text_bytes

MAX_EDITS = 0.2
TARGET_RECALL = 0.99
SAMPLED = 2
ITEM_BLOCK = 20_000
PAD = np.uint64(0)
SEED = 0x5851F42D4C957F2D


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges that cover 0..length, as even as can be."""
    cut = [length * i // (k + 1) for i in range(k + 2)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK outputs of rows of words, PAD after a row's end: the first two of the walk's three steps a word, which hold
    all that is sampled."""
    n, w = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), PAD)], axis=1)
    at, row = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, 2 * w), np.uint64)
    for t in range(2 * w):
        x = padded[row, at]
        out[:, t] = x
        bit = mix(x ^ np.uint64(SEED * (walk * 100_003 + t + 1) % 2**64)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), w)
    return out


def samples(walk: int, length: int) -> np.ndarray:
    """The sampled steps of a walk, among the first two a word; later ones mostly see padding."""
    return np.sort(np.random.default_rng((walk, length)).integers(0, max(1, 2 * length), SAMPLED))


def keys(windows: np.ndarray, walk: int, lengths: np.ndarray) -> np.ndarray:
    """A hash of the sampled outputs of each row of lengths[i] words."""
    out = embed(windows, walk)
    by_length = {n: samples(walk, n) for n in set(lengths.tolist())}
    at = np.array([by_length[n] for n in lengths.tolist()]).reshape(len(lengths), SAMPLED)
    h = np.zeros(len(windows), np.uint64)
    for c in range(SAMPLED):
        h = mix(h * np.uint64(31) + out[np.arange(len(out)), at[:, c]])
    return h


def mutated(rng: np.random.Generator, item: np.ndarray, k: int) -> np.ndarray:
    x = list(item)
    for _ in range(k):
        kind, at = int(rng.integers(3)), int(rng.integers(max(1, len(x))))
        new = np.uint64(rng.integers(1, 2**63))
        if kind == 0 and x:
            x[at] = new
        elif kind == 1:
            x.insert(at, new)
        elif len(x) > 1:
            del x[at]
    return np.array(x, np.uint64)


def walks_for(length: int, k: int, target: float = TARGET_RECALL) -> int:
    """Walks R that find a pair at distance k with probability `target`, by the match rate of 200 random pairs."""
    if k == 0:
        return 1
    rng = np.random.default_rng(length)
    items = rng.integers(1, 2**63, (200, length)).astype(np.uint64)
    near = np.full((200, length), PAD)
    for i in range(200):
        m = mutated(rng, items[i], k)[:length]
        near[i, : len(m)] = m
    lens = np.full(200, length)
    rate = np.mean([keys(items, r, lens) == keys(near, r, lens) for r in range(4)])
    rate = min(0.9, max(0.02, rate))
    return math.ceil(math.log(1 - target) / math.log(1 - rate))


def edit_distance(items: np.ndarray, lengths: np.ndarray, regions: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least edit distance from the item (lengths[i] words) to a run of the region (lens[i] words), and
    where that run ends."""
    n, w = regions.shape
    prev = np.zeros((n, w + 1), np.int32)
    ramp = np.arange(w + 1, dtype=np.int32)
    for i in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > i)
        old = prev[on]
        cur = np.empty_like(old)
        cur[:, 0] = i + 1
        cur[:, 1:] = np.minimum(old[:, :-1] + (regions[on] != items[on, i][:, None]), old[:, 1:] + 1)
        # Insertions: the running minimum of cur[j] - j, plus j.
        prev[on] = np.minimum.accumulate(cur - ramp, axis=1) + ramp
    prev[ramp[None, :] > lens[:, None]] = np.iinfo(np.int32).max
    end = np.argmin(prev, axis=1)
    return prev[np.arange(n), end], end


def possible(items: np.ndarray, lengths: np.ndarray, regions: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether at most edits[i] of the item's words are missing from the region, as they are where it holds a leak."""
    missing = np.zeros(len(items), np.int64)
    for i in range(int(lengths.max(initial=0))):
        on = np.flatnonzero((lengths > i) & (missing <= edits))
        missing[on] += ~(regions[on] == items[on, i][:, None]).any(axis=1)
    return missing <= edits


def backwards(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each row's first lens[i] words in reverse, PAD after them."""
    idx = lens[:, None] - 1 - np.arange(rows.shape[1])
    return np.where(idx >= 0, np.take_along_axis(rows, np.maximum(idx, 0), 1), PAD)


def loose_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    words = Words(data, offsets, LOOSE)
    return words.hashes(fold=True), words.first


@dataclass
class Items:
    """A block of items with its seed index."""

    ids: list
    words: list[np.ndarray]
    edits: list[int]
    walks: list[int]
    index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[object, str]], max_edits: float = MAX_EDITS) -> Items:
        h, first = loose_hashes(pa.array([t for _, t in rows], pa.string()))
        words = [h[first[i] : first[i + 1]] for i in range(len(rows))]
        edits = [int(max_edits * len(w) + 1e-9) for w in words]
        walks = {n: walks_for(n, int(max_edits * n + 1e-9)) for n in {len(w) for w in words} if n}
        out = cls([i for i, _ in rows], words, edits, [walks.get(len(w), 0) for w in words])
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, (w, k) in enumerate(zip(words, edits, strict=True)):
            if len(w):
                for a, b in pieces(len(w), k):
                    g, _ = grams(w[a:b], np.array([0, b - a]), b - a)
                    by.setdefault(b - a, []).append((int(g[0]), i, a))
        for n, found in by.items():
            found.sort()
            hs = np.array([x[0] for x in found], np.uint64)
            out.index[n] = (hs, np.array([x[1] for x in found]), np.array([x[2] for x in found]))
        return out

    def seeds(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (item, text, first word of the window) of the seeds, a column each. A window may begin before its
        text."""
        found = []
        for n, (hs, who, offset) in self.index.items():
            g, ok = grams(h, first, n)
            at = np.flatnonzero(ok)
            at = at[lookup(g[at], hs) >= 0]
            lo, hi = np.searchsorted(hs, g[at], "left"), np.searchsorted(hs, g[at], "right")
            reps = hi - lo
            k = np.repeat(lo - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            at = np.repeat(at, reps)
            found.append(np.stack([who[k], np.searchsorted(first, at, "right") - 1, at - offset[k]]))
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)

    def regions(self, h: np.ndarray, first: np.ndarray, base: int) -> list[tuple[int, int, int, int, np.ndarray]]:
        """(item, text + base, window's first word in the region, region's first word in the text, region) of each
        seed: the words that an alignment with the seed can touch."""
        out = []
        for i, d, start in self.seeds(h, first).T.tolist():
            k, lo, hi = self.edits[i], int(first[d]), int(first[d + 1])
            a, b = max(lo, start - 2 * k), min(hi, start + len(self.words[i]) + 2 * k)
            if b > a:
                out.append((i, d + base, start - a, a - lo, h[a:b].copy()))
        return out

    def leaks(self, regions: list[tuple[int, int, int, int, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance) of the best run for each text and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        groups: dict[int, list] = {}
        for r in regions:
            groups.setdefault(len(self.words[r[0]]).bit_length(), []).append(r)
        for g in groups.values():
            for lo in range(0, len(g), 2048):
                self._match(g[lo : lo + 2048], best)
        return [(d, i, a, n, e) for (d, i), (e, a, n) in sorted(best.items())]

    def _match(self, regions: list, best: dict) -> None:
        n = len(regions)
        who = np.array([r[0] for r in regions])
        k = np.array([self.edits[i] for i in who])
        length = np.array([len(self.words[i]) for i in who])
        walks = np.array([self.walks[i] for i in who])
        start = np.array([r[2] for r in regions])
        lens = np.array([len(r[4]) for r in regions])
        wide = int(length.max())
        items = np.full((n, wide), PAD)
        words = np.full((n, int(lens.max()) + 1), PAD)
        for j, r in enumerate(regions):
            items[j, : length[j]] = self.words[who[j]]
            words[j, : lens[j]] = r[4]
        hit, step, col = np.zeros(n, bool), np.maximum(1, k // 2), np.arange(wide)
        for walk in range(int(walks.max())):
            target = None
            for times in (0, 1, -1, 2, -2, 3, -3):
                todo = np.flatnonzero(~hit & (walks > walk) & (abs(times) * step <= k))
                if not len(todo):
                    continue
                if target is None:
                    target = np.zeros(n, np.uint64)
                    target[todo] = keys(items[todo], walk, length[todo])
                idx = np.maximum(start[todo] + times * step[todo], 0)[:, None] + col
                inside = (idx < lens[todo][:, None]) & (col < length[todo][:, None])
                window = np.where(inside, np.take_along_axis(words[todo], np.minimum(idx, words.shape[1] - 1), 1), PAD)
                hit[todo] = keys(window, walk, length[todo]) == target[todo]
        hit |= possible(items, length, words, k)
        j = np.flatnonzero(hit)
        if not len(j):
            return
        dist, end = edit_distance(items[j], length[j], words[j], lens[j])
        _, size = edit_distance(backwards(items[j], length[j]), length[j], backwards(words[j], end), end)
        for at, e, stop, m in zip(j.tolist(), dist.tolist(), end.tolist(), size.tolist(), strict=True):
            i, d, _, offset, _ = regions[at]
            now = (e, offset + stop - m, m)
            if e <= k[at] and ((d, i) not in best or now < best[d, i]):
                best[d, i] = now


def _blocks(benchmark: DataFrame, max_edits: float) -> Iterator[Items]:
    """The items, ITEM_BLOCK at a time; at least one block."""
    block, made = [], 0
    for r in benchmark.select("item_id", "text").orderBy(F.xxhash64("item_id", "text")).toLocalIterator():
        block.append((r.item_id, r.text or ""))
        if len(block) == ITEM_BLOCK:
            yield Items.of(block, max_edits)
            block, made = [], made + 1
    if block or not made:
        yield Items.of(block, max_edits)


def _scan(items: Items, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    data, offsets = text_bytes(column)
    near = []
    for i, j in slices(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LOOSE)
        near += items.regions(words.hashes(fold=True), words.first, i)
    return items.leaks(near)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, text: str = "text") -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, start_word, n_words, distance, item_words."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", benchmark.schema["item_id"].dataType)])
    for name in ("start_word", "n_words", "distance", "item_words"):
        schema.add(name, T.IntegerType())
    kinds = to_arrow_schema(schema).types

    def scan(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _scan(items, batch.column(1))
                if found:
                    d, k, a, n, e = zip(*found, strict=True)
                    cols = [batch.column(0).take(pa.array(d)), pa.array([items.ids[x] for x in k])]
                    cols += [pa.array(x, pa.int32()) for x in (a, n, e, [len(items.words[x]) for x in k])]
                    yield pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(cols, kinds, strict=True)], names=schema.names)

        return docs.select("doc_id", text).mapInArrow(run, schema)

    found = [scan(items) for items in _blocks(benchmark, max_edits)]
    result = found[0]
    for x in found[1:]:
        result = result.unionByName(x)
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, text: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns; texts are scanned where they are, without a shuffle."""
    place = docs.columns.index(text)

    def clean(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in _scan(items, batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for items in _blocks(benchmark, max_edits):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs
