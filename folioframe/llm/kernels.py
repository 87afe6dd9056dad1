"""Vectorised text kernels: words, word hashes and n-gram hashes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that the kernels take at a time.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators of loose words: all ASCII but letters and digits.
LOOSE = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(CHUNK + 1, n)
        base = int(_BASES[which])
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, U64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U64))
        have = (made[0], made[1])
        if size <= 8 * CHUNK:
            _POWERS[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, one text after the other, and the n + 1 text offsets. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = CHUNK):
    """Ranges (i, j) of texts of at most `most` bytes together, or a single longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts: byte ranges `start`, `end`, and `first`, the n + 1 word offsets of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        body = inside[1:-1]
        self.start = np.flatnonzero(body & (~inside[:-2] | cut[:-1]))
        self.end = np.flatnonzero(body & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, fold: bool = False, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; fold: A-Z count as a-z."""
        return self.prefix_hashes((0,), fold, which)[0]

    def prefix_hashes(self, lengths: tuple[int, ...], fold: bool = False, which: int = 0) -> list[np.ndarray]:
        """For each length a hash of that many first bytes of each word (0: the word); shorter words: of the word."""
        outs = [np.empty(len(self.start), U64) for _ in lengths]
        table = _TABLES[which][_FOLD] if fold else _TABLES[which]
        lo = 0
        while lo < len(self.start):
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, base + CHUNK, "right")))
            stop = self.end[hi - 1]
            up, down = powers(int(stop - base), which)
            total = np.empty(stop - base + 1, U64)
            total[0] = 0
            np.cumsum(table[self.data[base:stop]] * up[: stop - base], dtype=U64, out=total[1:])
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            for k, out in zip(lengths, outs, strict=True):
                t = np.minimum(e, s + k) if k else e
                out[lo:hi] = (total[t] - total[s]) * down[s] + (t - s).astype(U64)
            lo = hi
        return [mix(out) for out in outs]

    def docs(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(h: np.ndarray, first: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive values at every position (those that would leave the array: zero) and whether the k
    values lie in one text."""
    n = len(h)
    out, ok = np.zeros(n, U64), np.zeros(n, bool)
    if n < k:
        return out, ok
    step = CHUNK // 2
    for lo in range(0, n - k + 1, step):
        hi = min(n - k + 1, lo + step)
        up, down = powers(hi - lo + k, which)
        total = np.empty(hi - lo + k, U64)
        total[0] = 0
        np.cumsum(h[lo : hi + k - 1] * up[: hi - lo + k - 1], dtype=U64, out=total[1:])
        out[lo:hi] = (total[k:] - total[: hi - lo]) * down[: hi - lo]
    last = np.maximum(first[1:] - k + 1, first[:-1])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first[:-1], 1)
    np.add.at(edge, last, -1)
    ok[:] = np.cumsum(edge[:-1]) > 0
    return mix(out + U64(k)), ok


def lookup(keys: np.ndarray, table: np.ndarray, bits: int = 20) -> np.ndarray:
    """For each key its place in the sorted `table`, or -1. A bit table settles most of the misses."""
    out = np.full(len(keys), -1, np.int64)
    if not len(table) or not len(keys):
        return out
    bits = min(24, max(bits, int(len(table)).bit_length() + 4))
    shift = U64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    seen[(table >> shift).astype(np.int64)] = True
    hit = np.flatnonzero(seen[(keys >> shift).astype(np.int64)])
    k = keys[hit]
    p = np.minimum(np.searchsorted(table, k), len(table) - 1)
    good = table[p] == k
    out[hit[good]] = p[good]
    return out


def runs_cover(starts_flag: np.ndarray, width: int, first: np.ndarray) -> np.ndarray:
    """Positions covered by the flagged windows of `width`; windows never cross texts (flags respect that)."""
    n = len(starts_flag)
    edge = np.zeros(n + width + 1, np.int32)
    at = np.flatnonzero(starts_flag)
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:n]) > 0


class HashIndex:
    """An open-addressing table from 64-bit keys to 0, 1, 2, ... in order of arrival, vectorised."""

    def __init__(self, bits: int = 16):
        self.bits = bits
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(1 << bits, U64)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), (keys >> U64(64 - self.bits)).astype(np.int64)
        while len(todo):
            at = self.slots[slot]
            hit = at >= 0
            same = hit & (self.keys[at] == keys[todo])
            out[todo[same]] = at[same]
            go = hit & ~same
            todo, slot = todo[go], (slot[go] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        if 2 * (self.size + len(keys)) > len(self.slots):
            old = self.keys[: self.size]
            bits = int(4 * (self.size + len(keys))).bit_length()
            self.__init__(bits)
            self._put(old)
        self._put(keys)

    def _put(self, keys: np.ndarray) -> None:
        self.keys[self.size : self.size + len(keys)] = keys
        number = np.arange(self.size, self.size + len(keys))
        slot = (keys >> U64(64 - self.bits)).astype(np.int64)
        while len(number):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slots[slot[won]] = number[won]
            go = np.ones(len(number), bool)
            go[won] = False
            number, slot = number[go], (slot[go] + 1) & (len(self.slots) - 1)
        self.size += len(keys)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the byte ranges start..end, whose starts ascend."""
    out = np.empty(len(start), U64)
    lo = 0
    while lo < len(start):
        base = start[lo]
        hi = max(lo + 1, int(np.searchsorted(start, base + CHUNK, "left")))
        stop = int(end[lo:hi].max())
        up, down = powers(int(stop - base), which)
        total = np.empty(stop - base + 1, U64)
        total[0] = 0
        np.cumsum(_TABLES[which][data[base:stop]] * up[: stop - base], dtype=U64, out=total[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(U64)
        lo = hi
    return mix(out)


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes at every position but the last k - 1."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        up, down = powers(hi - lo + k, 0)
        total = np.empty(hi - lo + k, U64)
        total[0] = 0
        np.cumsum(_TABLES[0][data[lo : hi + k - 1]] * up[: hi - lo + k - 1], dtype=U64, out=total[1:])
        out[lo:hi] = (total[k:] - total[: hi - lo]) * down[: hi - lo]
    return mix(out)


def expand(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (lens[i] of them) for all i, end to end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - lens), lens)
