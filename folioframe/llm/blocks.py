"""Packed exchange: sorted 64-bit keys travel between steps in compressed blocks instead of one row a key.

A block is a row (dst, src, kind, payload). `dst` names a range of the key space, `src` the bucket of documents that
sent it. Keys are stored sorted, as differences, byte plane by byte plane, compressed with zstd; so a key of 64 bits
takes five to six bytes. Each bucket sends a key once, however many of its documents hold it, so a key that a third of
all documents share reaches its reducer once a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
BLOCKS = "dst int, src int, kind int, payload binary"
ARROW_BLOCKS = pa.schema([("dst", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def pack(*columns: np.ndarray) -> bytes:
    """Integer arrays of one length as bytes."""
    n = len(columns[0]) if columns else 0
    planes = [np.array([n, len(columns)], np.int64).tobytes()]
    for c in columns:
        planes.append(np.ascontiguousarray(c.astype(np.int64, copy=False).view(np.uint8).reshape(n, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, k = np.frombuffer(raw, np.int64, 2)
    out = []
    for i in range(k):
        planes = np.frombuffer(raw, np.uint8, n * 8, 16 + i * n * 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).reshape(n))
    return out


def pack_keys(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted unsigned keys, with columns of integers beside them."""
    delta = np.diff(keys, prepend=U64(0))
    return pack(delta.view(np.int64), *columns)


def unpack_keys(payload: bytes) -> list[np.ndarray]:
    delta, *rest = unpack(payload)
    return [np.cumsum(delta.view(U64), dtype=U64), *rest]


def scatter(src: int, keys: np.ndarray, columns: tuple[np.ndarray, ...], parts: int, kind: int = 0) -> pa.Table:
    """Blocks of the sorted keys, one for each of `parts` ranges of the key space that has any."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(U64)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    dst = np.flatnonzero(np.diff(cut))
    load = [pack_keys(keys[cut[d] : cut[d + 1]], *(c[cut[d] : cut[d + 1]] for c in columns)) for d in dst]
    return rows(dst, [src] * len(dst), [kind] * len(dst), load)


def rows(dst, src, kind, payload) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.asarray(dst, np.int32)), pa.array(np.asarray(src, np.int32)), pa.array(np.asarray(kind, np.int32)), pa.array(payload, pa.binary())], schema=ARROW_BLOCKS)


def gather(table: pa.Table) -> list[tuple[int, int, list[np.ndarray]]]:
    """(src, kind, [keys, columns]) of each block, in a fixed order."""
    d = table.to_pydict()
    order = sorted(range(len(d["src"])), key=lambda i: (d["src"][i], d["kind"][i], d["dst"][i]))
    return [(d["src"][i], d["kind"][i], unpack_keys(d["payload"][i])) for i in order]


def concat(parts: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Blocks of `width` arrays end to end."""
    if not parts:
        return [np.zeros(0, U64)] + [np.zeros(0, np.int64)] * (width - 1)
    return [np.concatenate([p[i] for p in parts]) for i in range(width)]
