"""Suffix arrays by the difference-cover algorithm (cover {1, 2} modulo 3) on integer arrays."""

from __future__ import annotations

import numpy as np


def named(*columns: np.ndarray) -> np.ndarray:
    """Dense names, from 1, of the rows of the columns, in their order."""
    key, size = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        top = int(c.max(initial=0)) + 1
        if size * top >= 1 << 62:
            key = named(key) - 1
            size = int(key.max(initial=0)) + 1
        key = key * top + c
        size *= top
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), np.int64)
    new[1:] = k[1:] != k[:-1]
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(new)
    return out


def ranks(s: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of all suffixes of s, whose values are 1 or more.

    Triples at the cover's positions are sorted and named; if names repeat, the string of names is ranked in turn; the
    remaining suffixes are sorted by (value, rank of the next) and merged in by their keys among those of either kind.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    # With a dummy triple where n % 3 == 1, so that the first half of the names ends in a triple of its own.
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    rank = np.zeros(n + 4, np.int64)
    if len(sample):
        names = named(t[sample], t[sample + 1], t[np.minimum(sample + 2, n + 2)])
        if names.max() < len(names):
            names = ranks(names)
        rank[sample] = names
        rank[n:] = 0
        by_rank = np.empty_like(sample)
        by_rank[names - 1] = sample
        sample = by_rank[by_rank < n]
    # Keys of suffixes of one kind are in suffix order: (value, rank of the next), or (two values, rank after them).
    wide, top = n + 4, int(t.max()) + 1
    zero = np.arange(0, n, 3)
    key = t[zero] * wide + rank[zero + 1]
    order = np.argsort(key)
    zero, key = zero[order], key[order]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    lo = np.searchsorted(t[first] * wide + rank[first + 1], key)
    pairs = t[second] * top + t[second + 1], t[zero] * top + t[zero + 1]
    if top * top * wide >= 1 << 62:
        both = named(np.concatenate(pairs))
        pairs = both[: len(second)], both[len(second) :]
    lo += np.searchsorted(pairs[0] * wide + rank[second + 2], pairs[1] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    # A merged suffix's place: its place among its own kind plus those of the other kind before it.
    out[zero] = np.arange(len(zero)) + lo + 1
    out[sample] = np.arange(len(sample)) + np.searchsorted(lo, np.arange(len(sample)), "right") + 1
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    r = ranks(s)
    out = np.empty(len(r), np.int64)
    out[r - 1] = np.arange(len(r))
    return out


def prefix_classes(data: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `valid` in suffix order and for each whether its `width` bytes differ from those of the one before.
    `data` has values of 0..255 and 256 or more as separators; every valid position has `width` bytes before one."""
    order = suffix_array(data.astype(np.int64) + 1)
    order = order[valid[order]]
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    todo = np.arange(len(same))
    for k in range(width):
        todo = todo[data[order[todo] + k] == data[order[todo + 1] + k]]
    same[:] = False
    same[todo] = True
    new[1:] = ~same
    return order, new
