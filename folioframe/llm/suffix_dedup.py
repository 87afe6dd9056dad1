"""Suffix-array dedup over bytes.

A byte is removed if a `width`-byte string covers it that also starts in a document of smaller doc_id.

1. Every string of `width` bytes picks one of its GRAM-byte grams, the one of least hash (the first of several). Equal
   strings pick the same gram, so only strings whose gram occurs in two documents can repeat. Buckets of documents send
   the picked grams' hashes once each, and learn which are shared.
2. The strings that picked a shared gram form one stretch of at most 2 * width - GRAM bytes around it. Buckets send
   each distinct stretch with the least doc_id to the reducer of the gram.
3. A reducer sorts the suffixes of the distinct stretches of grams that have several by the difference-cover algorithm: sampled triples are
   sorted and named, names are ranked recursively while any repeats, the remaining suffixes are merged
   in, and adjacent suffixes' `width`-byte prefixes are compared (byte by byte). Strings of one class share their least
   doc_id, which goes back to the buckets.

The suffix array is so distributed by gram: one array over all bytes of the corpus would have to move 8 bytes or more
for each byte of text, several times. A bucket sends a gram or stretch once, so copies and common passages meet as
one entry a bucket.

Hot grams: near the ends of a passage that very many documents share, each has a stretch of its own around the same
gram. Buckets count the differing stretches of such grams in step 1. A gram with more than HOT_STRETCHES in all is
split: each of its strings goes to a reducer by its own 128-bit hash, with the least doc_id, instead of in a stretch.
Equal strings still meet, and no reducer takes more than HOT_STRETCHES of a gram, and a few from each bucket.

Cases: null or empty text has no bytes; matches never cross documents; a null doc_id neither removes nor is removed
from; documents of one doc_id do not remove from each other; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from folioframe.llm.blocks import ARROW_BLOCKS, BLOCKS, concat, gather, pack, pack_keys, rows, scatter, unpack, unpack_keys
from folioframe.llm.kernels import byte_grams, expand, lookup, mix, range_hashes, runs_cover
from folioframe.llm.runtime import bucketed, parts_for
from folioframe.llm.substring import NO_DOC, bucket_texts, least_by_key, least_doc, pair_place, send_keys, shared_keys
from folioframe.llm.suffix import prefix_classes

U64 = np.uint64
GRAM = 20
#: Bits of a place in the texts of a slice; Spark's strings are shorter than 2**31 bytes.
PLACE_BITS = 31
BATCH_BYTES = 1 << 20
SEPARATOR = 256
#: Differing stretches of a gram from which on its strings are spread over the reducers one by one.
HOT_STRETCHES = 8192
#: Kinds of blocks: grams or stretches, counts or lists of hot grams, strings of hot grams.
PLAIN, HOT, STRING = 0, 1, 2


def of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table.column("kind"), kind))


def as_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.set_column(2, ARROW_BLOCKS.field("kind"), pa.array(np.full(table.num_rows, kind, np.int32)))


def key_list(table: pa.Table) -> np.ndarray:
    """All keys of the blocks, ascending."""
    return np.sort(np.concatenate([x[0] for _, _, x in gather(table)] + [np.zeros(0, U64)]))


def picks(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of strings that picked the same gram: the text, the first string, how many, and the gram's hash."""
    none = np.zeros(0, np.int64)
    n = len(data) - width + 1
    if n <= 0:
        return none, none, none, none.astype(U64)
    g = byte_grams(data, GRAM)
    low = (g >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(g), dtype=U64)
    span, have = width - GRAM + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    place = (low[:n] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    lens = np.diff(offsets)
    long = np.flatnonzero(lens >= width)
    count = lens[long] - width + 1
    at = expand(offsets[long], count)
    text = np.repeat(long, count)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    # Least hashes crowd the low end of the key space; scrambled once more they spread over all reducers.
    return text[start], at[start], np.diff(np.append(start, len(at))), mix(g[place[at[start]]] + U64(1))


class Stretches:
    """The steps on one bucket of documents and on one range of grams."""

    def __init__(self, width: int, parts: int, texts: bool = False, hot: int = HOT_STRETCHES):
        self.width, self.parts, self.texts, self.hot = width, parts, texts, hot
        #: A bucket does not report grams with fewer further stretches than this.
        self.few = 1 + hot // 1000

    def send_grams(self, table: pa.Table) -> pa.Table:
        src = table.column("src")[0].as_py()
        keys, docs, runs = [], [], []
        for _, _, ids, data, offsets in bucket_texts(table):
            text, at, count, g = picks(data, offsets, self.width)
            keys.append(g >> U64(1))
            docs.append(ids[text])
            runs.append((data, at, at + count + self.width - 1))
        blocks = send_keys(src, keys, docs, self.parts)
        k, further = self._further(keys, runs)
        return pa.concat_tables([blocks, scatter(src, k << U64(1), (further,), self.parts, HOT)]) if len(k) else blocks

    def _further(self, keys: list[np.ndarray], runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Grams of a bucket that have `few` or more differing stretches beyond the first, ascending, and how many."""
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        often = k[n > self.few] << U64(1)
        ks, hs = [], []
        for key, (data, at, end) in zip(keys, runs, strict=True):
            hit = np.flatnonzero(lookup(key << U64(1), often) >= 0)
            ks.append(key[hit])
            hs.append(range_hashes(data, at[hit], end[hit]))
        k, h = np.concatenate(ks), np.concatenate(hs)
        order = np.lexsort((h, k))
        k, h = k[order], h[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        k, n = np.unique(k[new], return_counts=True)
        return k[n > self.few], n[n > self.few] - 1

    def shared_grams(self, table: pa.Table) -> pa.Table:
        """Reducer of step 1: the grams that two documents hold, for each bucket that sent them, and the hot ones."""
        found = shared_keys(of_kind(table, PLAIN))
        k, further = concat([x for _, _, x in gather(of_kind(table, HOT))], 2)
        k, at = np.unique(k, return_inverse=True)
        hot = k[np.bincount(at, weights=further, minlength=len(k)) > self.hot] >> U64(1)
        if not len(hot):
            return found
        n, load = found.num_rows, pack_keys(hot)
        return pa.concat_tables([found, rows(found.column("dst").to_numpy(), found.column("src").to_numpy(), [HOT] * n, [load] * n)])

    def _strings(self, data: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The strings of runs one by one: the run, the place, and the two halves of the hash."""
        run, at = np.repeat(np.arange(len(at)), count), expand(at, count)
        return run, at, range_hashes(data, at, at + self.width), range_hashes(data, at, at + self.width, 1).view(np.int64)

    def send_stretches(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return ARROW_BLOCKS.empty_table()
        src = docs.column("src")[0].as_py()
        found, hot = key_list(of_kind(replies, PLAIN)), key_list(of_kind(replies, HOT))
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        blobs, strings = [], []
        for _, _, ids, data, offsets in bucket_texts(docs):
            text, at, count, g = picks(data, offsets, self.width)
            k = np.flatnonzero((lookup((g >> U64(1)) << U64(1), found << U64(1)) >= 0) & (ids[text] != NO_DOC))
            text, at, count, g = text[k], at[k], count[k], g[k]
            if len(hot):
                split = lookup((g >> U64(1)) << U64(1), hot << U64(1)) >= 0
                run, _, one, two = self._strings(data, at[split], count[split])
                strings.append(least_by_key(one, two, ids[text[split]][run], np.zeros(len(run), np.int64)))
                text, at, count, g = text[~split], at[~split], count[~split], g[~split]
            size = count + self.width - 1
            h = range_hashes(data, at, at + size)
            # Distinct within the slice, of the least doc_id, which comes first.
            order = np.lexsort((ids[text], h, g))
            new = np.ones(len(order), bool)
            new[1:] = (g[order[1:]] != g[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(order)) - 1
            many = ids[text[order[start]]] != ids[text[order[stop]]] if len(start) else new
            one = order[start]
            blob = data[expand(at[one], size[one])]
            blobs.append(blob)
            for c, v in zip(cols, (g[one], h[one].view(np.int64), ids[text[one]], many.astype(np.int64), size[one]), strict=True):
                c.append(v)
        g, h, doc, many, size = (np.concatenate(c) for c in cols)
        blob = np.concatenate(blobs)
        offset = np.cumsum(size) - size
        order = np.lexsort((doc, h, g))
        g, h, doc, many, size, offset = g[order], h[order], doc[order], many[order], size[order], offset[order]
        if len(g):
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(g)) - 1
            many = np.maximum.reduceat(many, start) | (doc[start] != doc[stop])
            g, h, doc, size, offset = g[start], h[start], doc[start], size[start], offset[start]
        edges = (np.arange(1, self.parts, dtype=np.float64) * (2.0**64 / self.parts)).astype(U64)
        cut = np.concatenate([[0], np.searchsorted(g, edges), [len(g)]])
        dst = np.flatnonzero(np.diff(cut))
        load = []
        squeeze = zstandard.ZstdCompressor(level=1)
        for d in dst:
            p = slice(cut[d], cut[d + 1])
            head = pack_keys(g[p], h[p], doc[p], many[p], size[p])
            load.append(len(head).to_bytes(8, "little") + head + squeeze.compress(blob[expand(offset[p], size[p])].tobytes()))
        out = [rows(dst, [src] * len(dst), [PLAIN] * len(dst), load)]
        if len(hot):
            k, s, d, m = least_by_key(*concat(strings, 4))
            # The bucket needs its list of hot grams again at the end; a reducer sends it back as it is.
            out += [scatter(src, k, (s, d, m), self.parts, STRING), rows([src % self.parts], [src], [HOT], [pack_keys(hot)])]
        return pa.concat_tables(out)

    def classify(self, table: pa.Table) -> pa.Table:
        """Reducer: answers to stretches, and to strings of hot grams that several documents hold; hot lists as sent."""
        strings = as_kind(least_doc(of_kind(table, STRING)), STRING)
        return pa.concat_tables([self._stretches(of_kind(table, PLAIN)), strings, of_kind(table, HOT).cast(ARROW_BLOCKS)])

    def _stretches(self, table: pa.Table) -> pa.Table:
        """For each bucket and stretch that it sent, the least doc_id of each of its strings, NO_DOC where one document
        alone holds it."""
        d = table.to_pydict()
        blocks = []
        for i in sorted(range(table.num_rows), key=lambda i: d["src"][i]):
            raw = d["payload"][i]
            n = int.from_bytes(raw[:8], "little")
            head = unpack_keys(raw[8 : 8 + n])
            blocks.append((d["src"][i], head, np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 + n :]), np.uint8)))
        if not blocks:
            return ARROW_BLOCKS.empty_table()
        g, h, doc, many, size = (np.concatenate([b[1][c] for b in blocks]) for c in range(5))
        blob = np.concatenate([b[2] for b in blocks])
        offset = np.cumsum(size) - size
        order = np.lexsort((doc, h, g))
        new = np.ones(len(order), bool)
        new[1:] = (g[order[1:]] != g[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
        start = np.flatnonzero(new)
        klass = np.empty(len(order), np.int64)
        klass[order] = np.cumsum(new) - 1
        one = order[start]
        shared = (np.maximum.reduceat(many[order], start) > 0) | (np.diff(np.append(start, len(order))) > 1) if len(start) else new
        least = self._least(g[one], blob, offset[one], size[one], doc[one], shared)
        windows = size - self.width + 1
        first = np.cumsum(windows[one]) - windows[one]
        load, at = [], 0
        for _, head, _ in blocks:
            k = klass[at : at + len(head[0])]
            at += len(head[0])
            out = least[expand(first[k], windows[one][k])]
            body = pack_keys(head[0], head[1], windows[one][k])
            load.append(len(body).to_bytes(8, "little") + body + pack(np.diff(out, prepend=0)))
        return rows([d["dst"][0]] * len(load), [b[0] for b in blocks], [0] * len(load), load)

    def _least(self, g: np.ndarray, blob: np.ndarray, offset: np.ndarray, size: np.ndarray, doc: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The strings of the distinct stretches (sorted by gram), classified BATCH_BYTES of whole grams at a time."""
        windows = size - self.width + 1
        first = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), NO_DOC)
        edge = np.append(np.flatnonzero(np.diff(g, prepend=g[:1] ^ U64(1)) != 0), len(g))
        # Where all documents have one and the same stretch around a gram, it stands for all of its strings; the rest is
        # sorted.
        alone = edge[:-1][(np.diff(edge) == 1) & shared[edge[:-1]]]
        out[expand(first[alone], windows[alone])] = np.repeat(doc[alone], windows[alone])
        several = np.repeat(np.diff(edge) > 1, np.diff(edge))
        if not several.any():
            return out
        kept = np.flatnonzero(several)
        g, offset, size, doc, shared, windows, first = (x[kept] for x in (g, offset, size, doc, shared, windows, first))
        edge = np.append(np.flatnonzero(np.diff(g, prepend=g[:1] ^ U64(1)) != 0), len(g))
        ends = np.concatenate([[0], np.cumsum(size + 1)])
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(ends[edge], ends[edge[i]] + BATCH_BYTES, "right")) - 1)
            lo, hi = edge[i], edge[j]
            i = j
            s = size[lo:hi]
            stop = np.cumsum(s + 1)
            text = np.full(int(stop[-1]), SEPARATOR, np.int16)
            body = expand(stop - 1 - s, s)
            text[body] = blob[expand(offset[lo:hi], s)]
            begin = expand(stop - 1 - s, windows[lo:hi])
            valid = np.zeros(len(text), bool)
            valid[begin] = True
            order, new = prefix_classes(text, valid, self.width)
            who = np.repeat(np.arange(lo, hi), windows[lo:hi])
            place = np.empty(len(text), np.int64)
            place[begin] = np.arange(len(begin))
            p = place[order]
            start = np.flatnonzero(new)
            klass = np.cumsum(new) - 1
            low = np.minimum.reduceat(doc[who[p]], start)
            high = np.maximum.reduceat(doc[who[p]], start)
            more = np.maximum.reduceat(shared[who[p]].astype(np.int8), start).astype(bool) | (low != high)
            got = np.where(more, low, NO_DOC)[klass]
            out[expand(first[lo:hi], windows[lo:hi])[p]] = got
        return out

    def finish(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        schema = RESULT_TEXT if self.texts else RESULT
        if not docs.num_rows:
            return schema.empty_table()
        heads, values = [], []
        for raw in of_kind(replies, PLAIN).column("payload").to_pylist():
            n = int.from_bytes(raw[:8], "little")
            heads.append(unpack_keys(raw[8 : 8 + n]))
            values.append(np.cumsum(unpack(raw[8 + n :])[0]))
        if heads:
            g, h, windows = (np.concatenate([x[c] for x in heads]) for c in range(3))
            least = np.concatenate(values)
            first = np.cumsum(windows) - windows
            order = np.lexsort((h, g))
            g, h, first = g[order], h[order], first[order]
        hot = key_list(of_kind(replies, HOT))
        one, two, lowest = concat([x for _, _, x in gather(of_kind(replies, STRING))], 3)
        order = np.lexsort((two, one))
        one, two, lowest = one[order], two[order], lowest[order]
        out = []
        for _, _, ids, data, offsets in bucket_texts(docs):
            flag = np.zeros(len(data), bool)
            if len(one) or (heads and len(g)):
                text, at, count, key = picks(data, offsets, self.width)
            if len(one):
                split = np.flatnonzero((lookup((key >> U64(1)) << U64(1), hot << U64(1)) >= 0) & (ids[text] != NO_DOC))
                run, place, a, b = self._strings(data, at[split], count[split])
                p = pair_place(a, b, one, two)
                flag[place[(p >= 0) & (lowest[p] < ids[text[split]][run])]] = True
            if heads and len(g):
                k = np.flatnonzero(lookup(key, g) >= 0)
                text, at, count, key = text[k], at[k], count[k], key[k]
                hash_ = range_hashes(data, at, at + count + self.width - 1).view(np.int64)
                p = pair_place(key, hash_, g, h)
                have = np.flatnonzero((p >= 0) & (ids[text] != NO_DOC))
                low = least[expand(first[p[have]], count[have])]
                mine = np.repeat(ids[text[have]], count[have])
                flag[expand(at[have], count[have])[low < mine]] = True
            gone = runs_cover(flag, self.width, offsets)
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            edges = offsets[:-1][offsets[:-1] < len(gone)]
            begin[edges] |= gone[edges]
            totals = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, begin, ~gone)]
            removed, spans, cut = totals[0][offsets], totals[1][offsets], totals[2][offsets].tolist()
            raw = data[~gone].tobytes()
            kept = [raw[cut[i] : cut[i + 1]] for i in range(len(ids))]
            cols = [pa.array([None if x == NO_DOC else x for x in ids.tolist()], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(np.diff(spans), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            out.append(pa.Table.from_arrays(cols + ([pa.array(kept, pa.binary())] if self.texts else []), schema=schema))
        return pa.concat_tables(out)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
RESULT_TEXT = RESULT.append(pa.field("kept", pa.binary()))


def dedup_bytes(docs: DataFrame, width: int = 50, with_text: bool = False, hot: int = HOT_STRETCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and the kept bytes if asked for."""
    if width <= GRAM:
        raise ValueError(f"a string takes more than {GRAM} bytes")
    parts = parts_for(docs)
    step = Stretches(width, parts, with_text, hot)
    dealt = bucketed(docs.selectExpr("doc_id", "text"), "doc_id", "text", parts)
    grams = dealt.groupBy("src").applyInArrow(lambda t: step.send_grams(t), BLOCKS)
    shared = grams.groupBy("dst").applyInArrow(lambda t: step.shared_grams(t), BLOCKS)
    stretches = dealt.groupBy("src").cogroup(shared.groupBy("src")).applyInArrow(lambda t, r: step.send_stretches(t, r), BLOCKS)
    least = stretches.groupBy("dst").applyInArrow(lambda t: step.classify(t), BLOCKS)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return dealt.groupBy("src").cogroup(least.groupBy("src")).applyInArrow(lambda t, r: step.finish(t, r), schema)
