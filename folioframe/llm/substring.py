"""Substring dedup over words with difference-cover anchors.

A word is removed if a window of `window` words covers it whose sequence also starts in a document of smaller doc_id.

Two equal windows at word positions i and j share a shift s below PERIOD at which i + s and j + s both lie in the
difference cover modulo PERIOD. So anchors of window - PERIOD + 1 words are hashed at cover positions alone (3 of 7),
and every repeated window has an anchor, at one of its first PERIOD words, whose twin is aligned with it.

1. Documents are dealt out by buckets of doc_id; each bucket sends the hashes of its anchors once to the reducers of the
   key space (packed blocks), which answer with those found in two documents.
2. Anchors so found extend to the windows around them. Their 128-bit hashes travel the same way with the bucket's least
   doc_id, and come back with the least of all, if it is another document's too.
3. Each bucket marks the windows whose least doc_id is smaller than the document's.

Every bucket sends a key once, so a passage that a third of all documents share costs its reducer one entry a bucket,
and no pairs of documents are ever listed. A task holds a bucket of documents or a range of keys.

Cases: null or empty text has no words; a null doc_id neither removes nor is removed from; documents of one doc_id do
not remove each other's words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioframe.llm.blocks import ARROW_BLOCKS, BLOCKS, concat, gather, pack_keys, rows, scatter
from folioframe.llm.kernels import Words, grams, lookup, runs_cover, slices, text_bytes
from folioframe.llm.runtime import bucketed, parts_for

U64 = np.uint64
PERIOD = 7
COVER = (0, 1, 3)
NO_DOC = np.iinfo(np.int64).max


def bucket_texts(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (i, j, doc_ids, bytes, offsets) of a bucket's documents. A null doc_id reads NO_DOC."""
    table = table.sort_by([("doc_id", "ascending")]).combine_chunks()
    ids = table.column("doc_id").fill_null(NO_DOC).to_numpy().astype(np.int64)
    data, offsets = text_bytes(table.column("text"))
    for i, j in slices(offsets):
        yield i, j, ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def shared_keys(table: pa.Table) -> pa.Table:
    """Reducer of step 1: the keys (lowest bit: held by two documents of the bucket) that two documents hold, for each
    bucket that sent them."""
    got = gather(table)
    if not got:
        return ARROW_BLOCKS.empty_table()
    keys = np.concatenate([x[0] for _, _, x in got])
    at = np.concatenate([np.full(len(x[0]), k, np.int32) for k, (_, _, x) in enumerate(got)])
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    plain = keys >> U64(1)
    same = plain[1:] == plain[:-1]
    dup = (keys & U64(1)).astype(bool)
    dup[1:] |= same
    dup[:-1] |= same
    # A key held twice in one bucket is known there; it is sent back all the same, once.
    keys, at = plain[dup], at[dup]
    back = np.argsort(at, kind="stable")
    keys, at = keys[back], at[back]
    cut = np.searchsorted(at, np.arange(len(got) + 1))
    have = np.flatnonzero(np.diff(cut))
    dst = table.column("dst")[0].as_py()
    return rows([dst] * len(have), [got[k][0] for k in have], [0] * len(have), [pack_keys(keys[cut[k] : cut[k + 1]]) for k in have])


def least_doc(table: pa.Table) -> pa.Table:
    """Reducer of step 2: of each key (two halves) that more than one document holds, the least doc_id, for each bucket
    that sent it. Blocks carry the second half, the bucket's least doc_id and whether two documents there hold it."""
    got = gather(table)
    if not got:
        return ARROW_BLOCKS.empty_table()
    keys, second, doc, many = concat([x for _, _, x in got], 4)
    at = np.concatenate([np.full(len(x[0]), k, np.int32) for k, (_, _, x) in enumerate(got)])
    order = np.lexsort((doc, second, keys))
    keys, second, doc, many, at = keys[order], second[order], doc[order], many[order], at[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])
    group = np.cumsum(new) - 1
    least = doc[new][group]
    size = np.bincount(group) + np.bincount(group, weights=many) if len(group) else np.zeros(0)
    keep = size[group] > 1
    keys, second, least, at = keys[keep], second[keep], least[keep], at[keep]
    back = np.argsort(at, kind="stable")
    keys, second, least, at = keys[back], second[back], least[back], at[back]
    cut = np.searchsorted(at, np.arange(len(got) + 1))
    have = np.flatnonzero(np.diff(cut))
    dst = table.column("dst")[0].as_py()
    load = [pack_keys(keys[cut[k] : cut[k + 1]], second[cut[k] : cut[k + 1]], least[cut[k] : cut[k + 1]]) for k in have]
    return rows([dst] * len(have), [got[k][0] for k in have], [0] * len(have), load)


def pair_place(keys: np.ndarray, second: np.ndarray, table_keys: np.ndarray, table_second: np.ndarray) -> np.ndarray:
    """The place of each (key, second) in a table sorted by both, or -1."""
    out = np.full(len(keys), -1, np.int64)
    todo = np.flatnonzero(lookup(keys, table_keys) >= 0)
    p = np.searchsorted(table_keys, keys[todo], "left")
    while len(todo):
        same = table_keys[p] == keys[todo]
        good = same & (table_second[p] == second[todo])
        out[todo[good]] = p[good]
        go = same & ~good & (p + 1 < len(table_keys))
        todo, p = todo[go], p[go] + 1
    return out


def send_keys(src: int, keys: list[np.ndarray], docs: list[np.ndarray], parts: int) -> pa.Table:
    """Blocks of the distinct keys (63 bits) of a bucket, with a lowest bit for keys of two of its documents."""
    k, d = np.concatenate(keys), np.concatenate(docs)
    k, d = k[d != NO_DOC], d[d != NO_DOC]
    order = np.argsort(k, kind="stable")
    k, d = k[order], d[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start) if len(k) else np.zeros(0, bool)
    return scatter(src, (k[start] << U64(1)) | many.astype(U64), (), parts)


def least_by_key(k: np.ndarray, s: np.ndarray, d: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """Distinct (k, s) with the least d and whether there are several d."""
    if not len(k):
        return [k, s, d, m]
    order = np.lexsort((d, s, k))
    k, s, d, m = k[order], s[order], d[order], m[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(k)) - 1
    many = np.maximum.reduceat(m, start) | (d[start] != d[stop])
    return [k[start], s[start], d[start], many]


class Anchors:
    """The three steps on one bucket of documents."""

    def __init__(self, window: int, parts: int):
        self.window, self.parts = window, parts
        self.size = window - PERIOD + 1

    def _anchors(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes (without the lowest bit) of the anchors."""
        g, ok = grams(h, first, self.size)
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        at = np.flatnonzero(ok & np.isin(np.arange(PERIOD), COVER)[place % PERIOD])
        return at, g[at] >> U64(1)

    def send_anchors(self, table: pa.Table) -> pa.Table:
        src = table.column("src")[0].as_py()
        keys, docs = [], []
        for _, _, ids, data, offsets in bucket_texts(table):
            w = Words(data, offsets)
            at, k = self._anchors(w.hashes(), w.first)
            keys.append(k)
            docs.append(ids[np.searchsorted(w.first, at, "right") - 1])
        return send_keys(src, keys, docs, self.parts)

    def _candidates(self, w: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and both hashes of the windows that have a found anchor."""
        h = w.hashes()
        at, k = self._anchors(h, w.first)
        at = at[lookup(k << U64(1), found << U64(1)) >= 0]
        n = len(h)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(edge, np.minimum(at + 1, n), -1)
        near = np.cumsum(edge[:n]) > 0
        if not near.any():
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
        g, ok = grams(h, w.first, self.window)
        at = np.flatnonzero(near & ok)
        other, _ = grams(w.hashes(which=1), w.first, self.window, which=1)
        return at, g[at], other[at].view(np.int64)

    def send_windows(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return ARROW_BLOCKS.empty_table()
        src = docs.column("src")[0].as_py()
        found = np.sort(np.concatenate([x[0] for _, _, x in gather(replies)]))
        parts = []
        for _, _, ids, data, offsets in bucket_texts(docs):
            w = Words(data, offsets)
            at, k, s = self._candidates(w, found)
            d = ids[np.searchsorted(w.first, at, "right") - 1]
            parts.append(least_by_key(k[d != NO_DOC], s[d != NO_DOC], d[d != NO_DOC], np.zeros((d != NO_DOC).sum(), np.int64)))
        k, s, d, m = least_by_key(*concat(parts, 4))
        return scatter(src, k, (s, d, m), self.parts)

    def finish(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if not docs.num_rows:
            return RESULT.empty_table()
        found = concat([x for _, _, x in gather(replies)], 3)
        order = np.lexsort((found[1], found[0]))
        found = [x[order] for x in found]
        for _, _, ids, data, offsets in bucket_texts(docs):
            w = Words(data, offsets)
            n = len(w)
            flag = np.zeros(n, bool)
            if len(found[0]) and n:
                h = w.hashes()
                g, ok = grams(h, w.first, self.window)
                at = np.flatnonzero(ok)
                at = at[lookup(g[at], found[0]) >= 0]
                if len(at):
                    other, _ = grams(w.hashes(which=1), w.first, self.window, which=1)
                    p = pair_place(g[at], other[at].view(np.int64), found[0], found[1])
                    d = ids[np.searchsorted(w.first, at, "right") - 1]
                    flag[at[(p >= 0) & (found[2][p] < d) & (d != NO_DOC)]] = True
            gone = runs_cover(flag, self.window, w.first)
            kept_bytes = _joined(w, ~gone)
            raw = kept_bytes[0].tobytes()
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[w.first[1:]] - total[w.first[:-1]]
            cut = kept_bytes[1].tolist()
            sha = [hashlib.sha256(raw[cut[2 * i] : cut[2 * i + 1]]).hexdigest() for i in range(len(ids))]
            kept = [raw[cut[2 * i] : cut[2 * i + 1]].decode("utf-8", "replace") for i in range(len(ids))] if self.texts else None
            cols = [pa.array([None if x == NO_DOC else x for x in ids.tolist()], pa.int64()), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
            out.append(pa.Table.from_arrays(cols + ([pa.array(kept, pa.string())] if self.texts else []), schema=RESULT_TEXT if self.texts else RESULT))
        return pa.concat_tables(out)

    texts = False


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
RESULT_TEXT = RESULT.append(pa.field("kept_text", pa.string()))


def _joined(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of all texts, each with one space after it, and for each text where its own begin and end (without
    the last space)."""
    k = np.flatnonzero(keep)
    size = w.end[k] - w.start[k]
    ends = np.cumsum(size + 1)
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 32, np.uint8)
    if total:
        body = np.ones(total, bool)
        body[ends - 1] = False
        inside = np.zeros(len(w.data) + 1, np.int32)
        inside[w.start[k]] += 1
        np.add.at(inside, w.end[k], -1)
        out[body] = w.data[np.cumsum(inside[:-1]) > 0]
    before = np.concatenate([[0], np.cumsum(keep)])[w.first]
    edge = np.concatenate([[0], ends])[before]
    stop = np.maximum(edge[1:] - 1, edge[:-1])
    return out, np.stack([edge[:-1], stop], axis=1).ravel()


def dedup_words(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document, and kept_text if asked for."""
    if window < PERIOD + 1:
        raise ValueError(f"a window takes {PERIOD + 1} words or more")
    parts = parts_for(docs)
    step = Anchors(window, parts)
    step.texts = with_text
    dealt = bucketed(docs.selectExpr("doc_id", "text"), "doc_id", "text", parts)
    anchors = dealt.groupBy("src").applyInArrow(lambda t: step.send_anchors(t), BLOCKS)
    shared = anchors.groupBy("dst").applyInArrow(shared_keys, BLOCKS)
    windows = dealt.groupBy("src").cogroup(shared.groupBy("src")).applyInArrow(lambda t, r: step.send_windows(t, r), BLOCKS)
    least = windows.groupBy("dst").applyInArrow(least_doc, BLOCKS)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    return dealt.groupBy("src").cogroup(least.groupBy("src")).applyInArrow(lambda t, r: step.finish(t, r), schema)
