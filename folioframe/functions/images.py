"""Images as (width, height, channels, bytes): container codecs, resampling and palettes. Arrow UDFs sit on top; an
image is one row, never one row a pixel."""

from __future__ import annotations

import struct
import zlib
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
IMAGE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("data", T.BinaryType())])


def png_decode(data: bytes) -> np.ndarray:
    """height x width x channels of an 8-bit file without interlacing, or of 1, 2 or 4 bits of grey or palette."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, alpha = 8, [], None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        at += size + 12
    if laced or depth == 16:
        raise ValueError("interlaced and 16-bit files are not supported")
    channels = CHANNELS[colour]
    step, line = max(1, channels * depth // 8), (width * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, line + 1)
    out = np.zeros((height, line), np.uint8)
    before = np.zeros(line, np.int32)
    for y in range(height):
        row, tag = raw[y, 1:].astype(np.int32), raw[y, 0]
        if tag == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step]) & 255
        elif tag == 2:
            row = row + before & 255
        elif tag in (3, 4):
            for i in range(line):
                left = int(row[i - step]) if i >= step else 0
                up, corner = int(before[i]), int(before[i - step]) if i >= step else 0
                if tag == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[i] = row[i] + guess & 255
        out[y], before = row, row
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)[:, : width * channels]
        out = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
        if palette is None:
            out = out * (255 // ((1 << depth) - 1))
    px = out.reshape(height, width, channels)
    if palette is not None:
        rgb = palette[px[:, :, 0]]
        if alpha:
            a = np.full(256, 255, np.uint8)
            a[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            rgb = np.concatenate([rgb, a[px]], axis=2)
        return rgb
    return px


def png_encode(px: np.ndarray) -> bytes:
    height, width, channels = px.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), px.reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def bmp_decode(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit files."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, size, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP file is not supported")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        n = struct.unpack("<I", data[46:50])[0] or 256
        table = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        return table[rows]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()


def pnm_decode(data: bytes) -> np.ndarray:
    """Binary bit, grey and colour maps (P4, P5, P6) and their plain forms (P1, P2, P3)."""
    kind, words, at = data[:2], [], 2
    need = 2 if kind in (b"P1", b"P4") else 3
    while len(words) < need:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words.append(int(data[at:end]))
        at = end
    width, height = words[:2]
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P5", b"P6"):
        px = np.frombuffer(data, np.uint8, width * height * channels, at + 1)
    elif kind == b"P1":
        px = np.array([255 * (c == 48) for c in data[at:] if c in b"01"][: width * height], np.uint8)
        return px.reshape(height, width, 1)
    else:
        px = np.array(data[at:].split()[: width * height * channels], np.int64)
    if need == 3 and words[2] != 255:
        px = (px.astype(np.int64) * 255 + words[2] // 2) // words[2]
    return px.astype(np.uint8).reshape(height, width, channels)


def weights(old: int, new: int) -> np.ndarray:
    """new x old: the share that each old cell has in each new one, fractional overlaps included."""
    edges = np.arange(new + 1) * old / new
    cells = np.arange(old)
    overlap = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    w = np.clip(overlap, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def resample(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average, rounded half up."""
    rows = np.einsum("ij,jkc->ikc", weights(px.shape[0], height), px.astype(np.float64))
    both = np.einsum("ij,kjc->kic", weights(px.shape[1], width), rows)
    return np.floor(both + 0.5).clip(0, 255).astype(np.uint8)


def size_at(width: int, height: int, dpi: float, target: float) -> tuple[int, int]:
    """A size at another resolution, rounded half to even, never enlarged nor below one."""
    scale = min(1.0, target / dpi)
    half_even = lambda x: int(Decimal(x).quantize(Decimal(1), ROUND_HALF_EVEN))
    return max(1, half_even(width * scale)), max(1, half_even(height * scale))


def popular_palette(px: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent colours; of equal counts the one seen first."""
    flat = px.reshape(-1, px.shape[2])
    colours, first, counts = np.unique(flat, axis=0, return_index=True, return_counts=True)
    return colours[np.lexsort((first, -counts))[:k]]


def to_palette(px: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The index of the nearest palette colour of each pixel, the first of several."""
    colours, back = np.unique(px.reshape(-1, px.shape[2]), axis=0, return_inverse=True)
    d = ((colours.astype(np.int64)[:, None] - palette.astype(np.int64)) ** 2).sum(axis=2)
    return np.argmin(d, axis=1)[back.ravel()].reshape(px.shape[:2])


DECODERS = ((SIGNATURE, png_decode), (b"BM", bmp_decode), *((f"P{i}".encode(), pnm_decode) for i in range(1, 7)))


def decode(data: bytes) -> np.ndarray:
    for mark, reader in DECODERS:
        if data.startswith(mark):
            return reader(data)
    raise ValueError("unknown image format")


@F.pandas_udf(IMAGE)
def decode_image(data: pd.Series) -> pd.DataFrame:
    """Images of files; null where a file cannot be read."""
    rows = []
    for x in data:
        try:
            px = decode(bytes(x))
            rows.append((px.shape[1], px.shape[0], px.shape[2], px.tobytes()))
        except Exception:  # noqa: BLE001 a damaged image is a row of nulls
            rows.append((None, None, None, None))
    return pd.DataFrame(rows, columns=["width", "height", "channels", "data"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})
