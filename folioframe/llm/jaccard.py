"""N-gram Jaccard join of documents with rare-first prefix filtering.

A document's set holds its distinct k-word shingles (A-Z folded; fewer words: the whole sequence as one; none: empty).
Documents link when |A & B| * den >= num * |A | B|; the result has the components of the links.

1. Documents of one set are a class; its least doc_id stands for it from here on.
2. Buckets send each shingle once with its count; reducers return the counts of those found more than once. The order
   of shingles is (count, hash), rare first, the same for all documents. (Counts go by the high 40 bits of the hash,
   which makes the order coarser, never inconsistent.)
3. A set of n shingles can link only by one of its first n - ceil(t n) + 1, and only if ceil(t n) of its shingles occur
   elsewhere. Sets that pass are written once, in order, as candidates.
4. Prefix shingles join: the candidates of a shingle are chained in order of size where the length filter holds
   between neighbours, so a shingle of m documents gives m - 1 chain links and no pairs. Components of the chains bound
   where links can be.
5. Inside a component an index over prefix shingles gives each candidate pair once, after the length, positional and
   suffix filters; pairs that are connected already need no check, all others are verified on the whole sets, class of
   shingles by class, until the rest cannot make a link. A component of over BLOCK_BYTES of sets is cut into bands of
   sizes (a set can link only inside its band or with the next one), and a band of over BLOCK_BYTES into pairs of
   blocks; their links' components are joined.

Cases: null or empty text has an empty set and links with nothing; a null doc_id is returned without a component;
repeated rows and ties belong to one class; rows of one doc_id count as one node; extra columns are ignored; an empty
table gives an empty result. The join finds components: forest_links counts the checked links that join a class to
others in its component's forest, not all of its links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.blocks import ARROW_BLOCKS, BLOCKS, concat, pack, pack_keys, rows, scatter, unpack, unpack_keys
from folioframe.llm.graph import components
from folioframe.llm.kernels import Words, expand, grams, mix, text_bytes
from folioframe.llm.runtime import bucketed, parts_for, persisted
from folioframe.llm.substring import NO_DOC, bucket_texts, pair_place

U64 = np.uint64
COUNT_MASK = U64(0xFFFFFFFFFF000000)
#: Bytes of sets (8 a shingle and SET_BYTES a set) that one side of a verifying task takes.
BLOCK_BYTES = 8 << 20
SET_BYTES = 256
#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"
#: Rows about large components that are broadcast.
TOLD_ROWS = 100_000
#: Classes of shingles, by hash, in which the suffix filter counts and pairs are verified.
CLASS_BITS = 4
#: Index entries or shingles that a verifying task looks at together.
AT_ONCE = 1 << 18
#: Prefix entries of candidates that are thinned together before they move.
ENTRIES_AT_ONCE = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the n + 1 offsets of texts."""
    w = Words(data, offsets)
    h = w.hashes(fold=True)
    n = len(offsets) - 1
    count = np.diff(w.first)
    doc = w.docs()
    g, ok = grams(h, w.first, k)
    parts, docs = [g[ok]], [doc[ok]]
    for short in range(1, k):
        have = np.flatnonzero(count == short)
        if len(have):
            s, _ = grams(h, w.first, short)
            parts.append(s[w.first[have]])
            docs.append(have)
    h, d = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    a = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(1)), dtype=U64)])
    b = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64)])
    n = np.diff(first).astype(U64)
    return mix(a[first[1:]] - a[first[:-1]] + n), mix(b[first[1:]] - b[first[:-1]])


class Join:
    def __init__(self, k: int, num: int, den: int, parts: int):
        self.k, self.num, self.den, self.parts = k, num, den, parts

    def least(self, n):
        """The shingles that a set of n must share to link at all."""
        return -(-self.num * n // self.den)

    def shared(self, a, b):
        """The shingles that sets of a and b must share."""
        return -(-self.num * (a + b) // (self.num + self.den))

    # Steps on a bucket of documents.

    def describe(self, table: pa.Table) -> pa.Table:
        """One row for each distinct set of a bucket, with its doc_ids; documents without doc_id have rows of their own."""
        src, got = table.column("src")[0].as_py(), []
        for _, _, ids, data, offsets in bucket_texts(table):
            h, first = shingle_sets(data, offsets, self.k)
            got.append((ids, np.diff(first), *signatures(h, first)))
        ids, n, a, b = (np.concatenate([x[i] for x in got]) for i in range(4))
        gone = ids == NO_DOC
        order = np.lexsort((ids, gone, b, a))
        ids, n, a, b, gone = ids[order], n[order], a[order], b[order], gone[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (gone[1:] != gone[:-1])) if len(ids) else gone
        start = np.flatnonzero(new)
        docs = pa.ListArray.from_arrays(pa.array(np.append(start, len(ids)), pa.int32()), pa.array(ids, pa.int64(), mask=gone))
        return pa.Table.from_arrays([pa.array(np.full(len(start), src, np.int32)), pa.array(n[start], pa.int64()), pa.array(a[start].view(np.int64)), pa.array(b[start].view(np.int64)), docs], names=["src", "n", "sig1", "sig2", "docs"])

    def _standing(self, docs: pa.Table, copies: pa.Table):
        """(doc_ids, sizes, shingles, offsets) of the sets that stand for their class, slice by slice."""
        told = [(a, b, c) for a, b, c in zip(*(copies.column(x).to_pylist() for x in ("sig1s", "sig2s", "standing")), strict=True) if a is not None]
        one, two, stands = (np.concatenate([np.zeros(0, np.int64), *[np.array(t[i], np.int64) for t in told]]) for i in range(3))
        order = np.lexsort((two, one.view(U64)))
        one, two, stands = one[order].view(U64), two[order], stands[order]
        for _, _, ids, data, offsets in bucket_texts(docs):
            h, first = shingle_sets(data, offsets, self.k)
            n = np.diff(first)
            keep = (n > 0) & (ids != NO_DOC)
            if len(one):
                a, b = signatures(h, first)
                p = pair_place(a, b.view(np.int64), one, two)
                keep &= (p < 0) | (stands[p] == ids)
            at = np.flatnonzero(keep)
            h = h[expand(first[at], n[at])]
            yield ids[at], n[at], h, np.concatenate([[0], np.cumsum(n[at])])

    def send_counts(self, docs: pa.Table, copies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ARROW_BLOCKS.empty_table()
        found = [h & COUNT_MASK for _, _, h, _ in self._standing(docs, copies)]
        keys, count = np.unique(np.concatenate(found), return_counts=True)
        return scatter(docs.column("src")[0].as_py(), keys, (count,), self.parts)

    def candidates(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        blocks = [unpack_keys(x) for x in replies.column("payload").to_pylist() if x is not None]
        keys = np.concatenate([np.zeros(0, U64), *[b[0] for b in blocks]])
        count = np.concatenate([np.zeros(0, np.int64), *[b[1] for b in blocks]])
        order = np.argsort(keys)
        keys, count = keys[order], count[order]
        out = []
        for ids, n, h, first in self._standing(docs, replies) if docs.num_rows else ():
            low = h & COUNT_MASK
            p = np.minimum(np.searchsorted(keys, low), max(0, len(keys) - 1))
            df = np.where(keys[p] == low, count[p], 1) if len(keys) else np.ones(len(h), np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            often = np.bincount(doc[df > 1], minlength=len(n))
            at = np.flatnonzero(often >= self.least(n))
            if not len(at):
                continue
            k = expand(first[at], n[at])
            d, f, g = doc[k], df[k], h[k]
            order = np.lexsort((g, f, d))
            g = g[order]
            cut = np.concatenate([[0], np.cumsum(n[at])])
            rare = np.cumsum(np.concatenate([[0], f[order] == 1]))
            sets = [g[cut[i] : cut[i + 1]].tobytes() for i in range(len(at))]
            out.append(pa.Table.from_arrays([pa.array(ids[at]), pa.array(n[at], pa.int64()), pa.array(rare[cut[1:]] - rare[cut[:-1]], pa.int64()), pa.array(sets, pa.binary())], schema=CANDIDATES))
        return pa.concat_tables(out) if out else CANDIDATES.empty_table()

    # Steps on candidates.

    def send_prefixes(self, batches):
        """Blocks (kind 0) of (prefix shingle; doc_id, size) of a partition's candidates, and blocks (kind 1) of links.

        Of the candidates of one shingle, in order of size, those stay out that lie between two others that the length
        filter lets meet: they are linked here, and whatever comes to lie between the two elsewhere is linked as well. So
        a shingle that all candidates share sends a few entries for each range of sizes."""
        held, entries = [], 0
        for batch in batches:
            doc, n, rare, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            data, offsets = text_bytes(sets)
            h = np.frombuffer(data.tobytes(), U64)
            some = np.maximum(n - self.least(n) + 1 - rare, 0)
            k = expand(offsets[:-1] // 8 + rare, some)
            held.append((h[k], np.repeat(doc, some), np.repeat(n, some)))
            entries += len(k)
            if entries >= ENTRIES_AT_ONCE:
                yield from self._thinned(held)
                held, entries = [], 0
        if entries:
            yield from self._thinned(held)

    def _thinned(self, held):
        key, doc, n = (np.concatenate([x[i] for x in held]) for i in range(3))
        order = np.lexsort((doc, n, key))
        key, doc, n = key[order], doc[order], n[order]
        same = key[1:] == key[:-1]
        link = same & (n[:-1] >= self.least(n[1:]))
        u, v = forest(doc[1:][link], doc[:-1][link])
        # An entry stays if one of its neighbours is not linked, or if its band of sizes differs from a neighbour's;
        # sizes of one band can always meet.
        band = self.band(n)
        edge = np.append(True, ~link | (band[1:] != band[:-1])) | np.append(~link | (band[1:] != band[:-1]), True)
        yield from scatter(0, key[edge], (doc[edge], n[edge]), self.parts).to_batches()
        if len(u):
            yield from rows([int(key[0] % U64(self.parts))], [0], [1], [pack(u, v)]).to_batches()

    def band(self, n):
        """Bands of sizes: two sizes that can meet lie in one band or in two neighbouring ones, and sizes of one band can
        meet. Band edges are the least sizes e with least(e) >= the edge before."""
        top, edges = int(n.max(initial=1)), [1]
        while edges[-1] <= top:
            edges.append(max(edges[-1] + 1, self.num and edges[-1] * self.den // self.num + 1))
        return np.searchsorted(np.array(edges), n, "right")

    def chain(self, table: pa.Table) -> pa.Table:
        """Reducer of a range of shingles: links between neighbours in size, as a forest."""
        load, kind = table.column("payload").to_pylist(), table.column("kind").to_pylist()
        blocks = [unpack_keys(x) for x, k in zip(load, kind, strict=True) if k == 0]
        key, doc, n = concat(blocks, 3)
        order = np.lexsort((doc, n, key))
        key, doc, n = key[order], doc[order], n[order]
        link = (key[1:] == key[:-1]) & (n[:-1] >= self.least(n[1:])) & (doc[1:] != doc[:-1])
        told = concat([unpack(x) for x, k in zip(load, kind, strict=True) if k == 1], 2)
        u, v = forest(np.concatenate([doc[1:][link], told[0].astype(np.int64)]), np.concatenate([doc[:-1][link], told[1]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def verify(self, table: pa.Table) -> pa.Table:
        """The forest of the links among the candidates of one component, or between two blocks (a and b) of one of its
        bands, where pairs of two `lower` sets belong to the band below.

        Memory stays near the sets' own size: the pairs of a set are listed AT_ONCE entries at a time."""
        table = table.sort_by([("n", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        doc, n, rare = (table.column(c).to_numpy() for c in ("doc_id", "n", "rare"))
        side, lower = (table.column(c).to_numpy() for c in ("side", "lower"))
        two = len(doc) and table.column("a")[0].as_py() != table.column("b")[0].as_py()
        m = len(doc)
        data, _ = text_bytes(table.column("grams"))
        h = np.frombuffer(data.tobytes(), U64)
        stop = np.cumsum(n)
        first = stop - n
        # The sets once more, sorted by hash: their classes are runs.
        classes = 1 << CLASS_BITS
        owner = np.repeat(np.arange(m, dtype=np.int32), n)
        sorted_sets = h[np.lexsort((h, owner))]
        run = owner.astype(np.int64) * classes + (sorted_sets >> U64(64 - CLASS_BITS)).astype(np.int64)
        run = np.searchsorted(run, np.arange(m * classes + 1))
        del owner
        whole = np.diff(run).reshape(m, classes)
        # The index holds the prefixes that a smaller set needs to meet a larger one, sorted by shingle, then by size.
        probe = np.maximum(n - self.least(n) + 1 - rare, 0)
        size = np.clip(n - self.shared(n, n) + 1 - rare, 0, probe)
        k = expand(first + rare, size)
        who = np.repeat(np.arange(m), size)
        place = k - first[who]
        order = np.lexsort((who, h[k]))
        key, who, place = h[k][order], who[order], place[order]
        after = self._suffixes(h, first, whole, who, place)
        lists = Components(m)
        links = []
        for x in range(m):
            px = np.arange(rare[x], rare[x] + probe[x])
            mine = h[first[x] + px]
            begin, end = np.searchsorted(key, mine), np.searchsorted(key, mine, "right")
            # Length filter: entries of one shingle ascend in size, and so in number.
            least = int(np.searchsorted(n, self.least(int(n[x]))))
            lo, hi = between(who, begin, end, least), between(who, begin, end, x)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            px, lo, lens = px[some], lo[some], (hi - lo)[some]
            seen = np.zeros(x - least, bool)
            mine_after = self._suffixes(h, first, whole, np.full(len(px), x), px)
            i = 0
            total = np.cumsum(lens)
            while i < len(px):
                j = max(i + 1, int(np.searchsorted(total, total[i] - lens[i] + AT_ONCE, "right")))
                at, p = expand(lo[i:j], lens[i:j]), np.repeat(np.arange(i, j), lens[i:j])
                i = j
                y = who[at]
                good = ~seen[y - least] & (lists.label[y] != lists.label[x]) & ~(lower[y] & lower[x])
                if two:
                    good &= side[y] != side[x]
                at, p, y = at[good], p[good], y[good]
                # The first shingle that a pair shares in the order decides.
                y, one = np.unique(y, return_index=True)
                at, p = at[one], p[one]
                seen[y - least] = True
                need = self.shared(int(n[x]), n[y])
                good = 1 + np.minimum(n[x] - px[p] - 1, n[y] - place[at] - 1) >= need  # positional filter
                at, p, y, need = at[good], p[good], y[good], need[good]
                good = 1 + np.minimum(after[at], mine_after[p]).sum(axis=1) >= need  # suffix filter
                y, need = y[good], need[good]
                links += self._linked(x, y, need, sorted_sets, run, whole, lists)
        u = doc[np.array([a for a, _ in links], np.int64)]
        v = doc[np.array([b for _, b in links], np.int64)]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    @staticmethod
    def _suffixes(h: np.ndarray, first: np.ndarray, whole: np.ndarray, who: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each entry (set, place in it) how many of the set's shingles after the place each class has."""
        classes = whole.shape[1]
        out = np.empty((len(who), classes), np.int32)
        order = np.lexsort((place, who))
        step = max(1, AT_ONCE // classes)
        for i in range(0, len(order), step):
            o = order[i : i + step]
            w, p = who[o], place[o]
            # Shingles between the places of one set are counted once, then summed up.
            same = np.append(False, w[1:] == w[:-1])
            since = np.where(same, np.append(-1, p[:-1]), -1)
            k = expand(first[w] + since + 1, p - since)
            got = np.zeros((len(o), classes), np.int32)
            np.add.at(got, (np.repeat(np.arange(len(o)), p - since), (h[k] >> U64(64 - CLASS_BITS)).astype(np.int64)), 1)
            got = np.cumsum(got, axis=0)
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))
            got -= np.where((start > 0)[:, None], got[start - 1], 0)
            out[o] = whole[w] - got
        return out

    def _linked(self, x: int, y: np.ndarray, need: np.ndarray, sets: np.ndarray, run: np.ndarray, whole: np.ndarray, lists: "Components") -> list[tuple[int, int]]:
        """Links of x with the sets y that are not connected yet; largest first, as they are likeliest."""
        classes, links = whole.shape[1], []
        y, need = y[::-1], need[::-1]
        while len(y):
            go = lists.label[y] != lists.label[x]
            y, need = y[go], need[go]
            many = max(1, int(np.searchsorted(np.cumsum(whole[y].sum(axis=1)), AT_ONCE)))
            part, want, y, need = y[:many], need[:many], y[many:], need[many:]
            both = np.zeros(len(part), np.int64)
            most = np.minimum(whole[part], whole[x])
            rest = most.sum(axis=1)
            for c in range(classes):
                if not len(part):
                    break
                mine = sets[run[x * classes + c] : run[x * classes + c + 1]]
                lens = run[part * classes + c + 1] - run[part * classes + c]
                flat = sets[expand(run[part * classes + c], lens)]
                hit = np.concatenate([[0], np.cumsum(mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat)]) if len(mine) else np.zeros(len(flat) + 1, np.int64)
                ends = np.cumsum(lens)
                both += hit[ends] - hit[ends - lens]
                rest -= most[:, c]
                go = both + rest >= want
                part, want, both, rest, most = part[go], want[go], both[go], rest[go], most[go]
            for z in part.tolist():
                if lists.join(x, z):
                    links.append((x, z))
        return links


def between(who: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """For each run begin..end of `who`, ascending in itself, the first place of `least` or more."""
    lo, hi = begin.copy(), end.copy()
    while (go := lo < hi).any():
        mid = (lo + hi) // 2
        small = go & (who[np.minimum(mid, len(who) - 1)] < least)
        lo = np.where(small, mid + 1, lo)
        hi = np.where(go & ~small, mid, hi)
    return lo


class Components:
    """Labels of sets that are connected; a union writes the smaller side's labels anew."""

    def __init__(self, m: int):
        self.label = np.arange(m)
        self.members: dict[int, list[int]] = {}

    def join(self, x: int, y: int) -> bool:
        a, b = int(self.label[x]), int(self.label[y])
        if a == b:
            return False
        mine, other = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(mine) < len(other):
            a, mine, other = b, other, mine
        self.label[other] = a
        mine += other
        self.members[a] = mine
        return True


CANDIDATES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("rare", pa.int64()), ("grams", pa.binary())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest of the same components as the links (u, v): each node but the least and its component's least."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(again := new[new], new):
            new = again
        new = new[label]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def sum_counts(table: pa.Table) -> pa.Table:
    """Reducer: the keys counted more than once and their totals, for each bucket that sent them."""
    d = table.to_pydict()
    order = sorted(range(table.num_rows), key=lambda i: d["src"][i])
    blocks = [unpack_keys(d["payload"][i]) for i in order]
    key, count = (np.concatenate([b[i] for b in blocks]) for i in range(2))
    at = np.repeat(np.arange(len(blocks)), [len(b[0]) for b in blocks])
    by = np.argsort(key, kind="stable")
    new = np.append(True, key[by][1:] != key[by][:-1])
    total = np.add.reduceat(count[by], np.flatnonzero(new))[np.cumsum(new) - 1]
    often = total > 1
    key, total, at = key[by][often], total[often], at[by][often]
    back = np.argsort(at, kind="stable")
    key, total, at = key[back], total[back], at[back]
    cut = np.searchsorted(at, np.arange(len(blocks) + 1))
    have = np.flatnonzero(np.diff(cut))
    load = [pack_keys(key[cut[k] : cut[k + 1]], total[cut[k] : cut[k + 1]]) for k in have]
    return rows([d["dst"][0]] * len(have), [d["src"][order[k]] for k in have], [0] * len(have), load)


def told(small: DataFrame) -> DataFrame:
    """Rows about components of over BLOCK_BYTES: broadcast while there are at most TOLD_ROWS, else joined by a shuffle."""
    small = persisted(small, "told")
    return F.broadcast(small) if small.count() <= TOLD_ROWS else small


def placed(found: DataFrame, bound: DataFrame, step: Join) -> DataFrame:
    """The verifying tasks of each candidate: doc_id, n, component, band, a, b, side, lower.

    Components of at most BLOCK_BYTES are one task. Of larger ones a set goes to its band and, as a lower one, to the
    next; a band of several blocks is dealt out as pairs of blocks."""
    at = found.select("doc_id", "n").distinct().join(bound.select(F.col("node").alias("doc_id"), "component"), "doc_id")
    # Bands a hair wider than the ratio that sizes may have, so that rounding cannot put sizes that meet two apart.
    ratio = math.log(step.den / step.num) + 1e-9
    at = at.withColumn("own", 1 + F.floor(F.log("n") / F.lit(ratio))).withColumn("bytes", F.col("n") * 8 + SET_BYTES)
    big = told(at.groupBy("component").agg(F.sum("bytes").alias("all")).where(F.col("all") > BLOCK_BYTES).select("component", F.lit(True).alias("big")))
    at = at.join(big, "component", "left")
    at = at.select("doc_id", "component", "n", "bytes", "own", F.explode(F.when(F.col("big"), F.array("own", F.col("own") + 1)).otherwise(F.array(F.lit(0).cast("bigint")))).alias("band"))
    blocks = at.where("band > 0").groupBy("component", "band").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"), F.max("own").alias("most"))
    # A band that holds lower sets only has no pairs of its own.
    blocks = told(blocks.select("component", "band", F.when(F.col("most") == F.col("band"), F.col("blocks")).otherwise(0).alias("blocks")))
    at = at.join(blocks, ["component", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).where("blocks > 0")
    at = at.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return at.select("doc_id", "n", "component", "band", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).alias("side"), ((F.col("band") > 0) & (F.col("own") < F.col("band"))).alias("lower"))


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id of the same set; null: empty set), forest_links."""
    parts = parts_for(docs)
    step = Join(k, num, den, parts)
    dealt = bucketed(docs.selectExpr("doc_id", "text"), "doc_id", "text", parts)
    # A row for each set and bucket: a text that a third of all documents copy has one row a bucket.
    sets = persisted(dealt.groupBy("src").applyInArrow(lambda t: step.describe(t), "src int, n bigint, sig1 bigint, sig2 bigint, docs array<bigint>"), "sets")
    full = sets.where("n > 0 AND docs[0] IS NOT NULL")
    least = full.groupBy("sig1", "sig2").agg(F.min(F.array_min("docs")).alias("class_id"), F.sum(F.size("docs")).alias("members")).where("members > 1")
    classes = full.join(least.drop("members"), ["sig1", "sig2"], "left").select("src", "sig1", "sig2", "n", "docs", F.coalesce("class_id", F.col("docs")[0]).alias("class_id"))
    classes = persisted(classes, "classes")
    copies = classes.where("size(docs) > 1 OR docs[0] <> class_id").groupBy("src").agg(*(F.collect_list(F.struct("sig1", "sig2", "class_id"))[c].alias(a) for c, a in (("sig1", "sig1s"), ("sig2", "sig2s"), ("class_id", "standing"))))
    copies = copies.selectExpr("src", "CAST(NULL AS binary) AS payload", "sig1s", "sig2s", "standing")
    counts = dealt.groupBy("src").cogroup(copies.groupBy("src")).applyInArrow(lambda t, r: step.send_counts(t, r), BLOCKS)
    often = counts.groupBy("dst").applyInArrow(sum_counts, BLOCKS)
    told = often.selectExpr("src", "payload", *(f"CAST(NULL AS array<bigint>) AS {c}" for c in ("sig1s", "sig2s", "standing"))).unionByName(copies)
    found = dealt.groupBy("src").cogroup(told.groupBy("src")).applyInArrow(lambda t, r: step.candidates(t, r), "doc_id bigint, n bigint, rare bigint, grams binary")
    found = persisted(found, "candidates")
    blocks = found.mapInArrow(lambda b: step.send_prefixes(b), BLOCKS)
    chains = blocks.groupBy("dst").applyInArrow(lambda t: step.chain(t), "u bigint, v bigint")
    bound = persisted(components(chains), "bounds")
    both = found.join(placed(found, bound, step), ["doc_id", "n"]).select("component", "band", "a", "b", "side", "lower", "doc_id", "n", "rare", "grams")
    links = both.groupBy("component", "band", "a", "b").applyInArrow(lambda t: step.verify(t), "u bigint, v bigint")
    links = persisted(links, "joined")
    linked = components(links)
    degree = links.select(F.col("u").alias("class_id")).unionByName(links.select(F.col("v").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("forest_links"))
    result = classes.select("n", "docs", "class_id").join(linked.select(F.col("node").alias("class_id"), "component"), "class_id", "left").join(degree, "class_id", "left")
    result = result.select(F.explode("docs").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id", F.coalesce("forest_links", F.lit(0).cast("bigint")).alias("forest_links"))
    rest = sets.where("n = 0 OR docs[0] IS NULL").select(F.explode("docs").alias("doc_id"), F.col("n").alias("n_shingles"))
    rest = rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("forest_links"))
    return result.unionByName(rest)


def numbered(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and text that has words: `_row`, and `_at`, numbers in order of doc_id (null last)."""
    name = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256)
    one = docs.where(F.col("text").rlike(WORD)).groupBy(name.alias("_name")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return persisted(one.orderBy(F.asc_nulls_last("_row.doc_id"), "_name").select("_row", F.monotonically_increasing_id().alias("_at")), "numbered")


def room(plain: DataFrame, one: DataFrame) -> int | None:
    """What to add to the numbers of `one` so that they come after all doc_ids of `plain`; None where that is too much."""
    high = plain.agg(F.max("doc_id")).first()[0]
    most = one.agg(F.max("_at")).first()[0] or 0
    if high is None:
        return 0
    return max(high, -1) + 1 if high + 1 + most < NO_DOC else None


def first_of_groups(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """`docs` with one row of each component of the join, its least doc_id.

    Rows without words belong to no group; all of them stay. Rows whose doc_id is null or repeated are documents by
    doc_id and text: equal ones are one (of different other columns the least stays), others are compared each on its
    own. They come after all rows of other doc_ids, so of a group with both a row of a doc_id of its own stays; where
    doc_ids reach so far up that there are no numbers above them, all rows come in order of doc_id, null last. Columns
    of `docs` must be of types with an order; extra ones are kept."""
    again = persisted(docs.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("doc_id IS NULL OR _rows > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        gone = join(docs, k, num, den).where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    known = docs.where("doc_id IS NOT NULL")
    plain = known.join(again, "doc_id", "left_anti").select(*docs.columns)
    odd = docs.where("doc_id IS NULL").unionByName(known.join(again, "doc_id", "left_semi"))
    one = numbered(odd)
    start = room(plain, one)
    if start is None:
        plain, odd, one, start = docs.where(F.lit(False)), docs, numbered(docs), 0
    one = one.select((F.col("_at") + F.lit(start)).alias("_at"), "_row")
    both = plain.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").unionByName(one.select(F.col("_at").alias("doc_id"), "_row.text"))
    gone = persisted(join(both, k, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")), "gone")
    kept = plain.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    first = one.join(gone, F.col("_at") == F.col("_gone"), "left_anti").select("_row.*")
    return kept.unionByName(first).unionByName(odd.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
