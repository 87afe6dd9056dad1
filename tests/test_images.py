import struct
import zlib

import numpy as np
import pytest

from folioframe.functions import images as im

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    px = RNG.integers(0, 256, (7, 5, channels)).astype(np.uint8)
    assert (im.png_decode(im.png_encode(px)) == px).all()


def test_png_filters_and_palette():
    px = RNG.integers(0, 256, (5, 6, 3)).astype(np.int64)
    lines, before = b"", np.zeros(18, np.int64)
    for tag, row in enumerate(px.reshape(5, 18)):
        left = np.concatenate([np.zeros(3, np.int64), row[:-3]])
        corner = np.concatenate([np.zeros(3, np.int64), before[:-3]])
        p = left + before - corner
        best = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0, left, before, (left + before) // 2, best][tag]
        lines += bytes([tag]) + bytes(((row - guess) & 255).tolist())
        before = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    data = im.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines))
    assert (im.png_decode(data) == px).all()
    small = im.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 1, 2, 3, 0, 0, 0)) + chunk(b"PLTE", bytes(range(12))) + chunk(b"IDAT", zlib.compress(b"\0" + bytes([0b00011100])))
    assert im.png_decode(small).tolist() == [[[0, 1, 2], [3, 4, 5], [9, 10, 11]]]


def test_other_containers():
    rows = np.array([[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [10, 11, 12]]], np.uint8)
    body = b"".join(r[:, ::-1].tobytes() + b"\0\0" for r in rows[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 0, 0, 0, 0, 0) + body
    assert (im.bmp_decode(bmp) == rows).all()
    assert im.pnm_decode(b"P4\n# c\n3 1\n\xa0")[0, :, 0].tolist() == [0, 255, 0]
    assert im.pnm_decode(b"P3 1 1 15 15 0 1").tolist() == [[[255, 0, 17]]]
    assert im.pnm_decode(b"P5 2 1 255\n\x01\x02")[0, :, 0].tolist() == [1, 2]


def test_resample_and_palette():
    px = np.array([[0, 1, 2], [3, 4, 5]], np.uint8)[:, :, None]
    assert im.resample(px, 1, 1)[0, 0, 0] == 3  # 2.5 goes up
    assert im.resample(px, 3, 2).tolist() == px.tolist()
    assert im.size_at(5, 100, 200, 100) == (2, 50) and im.size_at(5, 7, 72, 100) == (5, 7)
    c = np.array([[[9, 9, 9], [1, 1, 1], [9, 9, 9], [5, 5, 5], [1, 1, 1]]], np.uint8)
    palette = im.popular_palette(c, 2)
    assert palette.tolist() == [[9, 9, 9], [1, 1, 1]]
    assert im.to_palette(c, palette).tolist() == [[0, 1, 0, 0, 1]]


def test_udf(spark):
    px = RNG.integers(0, 256, (2, 3, 3)).astype(np.uint8)
    df = spark.createDataFrame([(1, bytearray(im.png_encode(px))), (2, bytearray(b"?"))], "i int, data binary")
    rows = df.select("i", im.decode_image("data").alias("x")).orderBy("i").collect()
    assert (rows[0].x.width, rows[0].x.height, bytes(rows[0].x.data)) == (3, 2, px.tobytes())
    assert rows[1].x is None or rows[1].x.width is None
