import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewright.functions.scalar import natural_key
from galewright.operators.images import read_packed_images
from galewright.sources import pictures as P


def filtered_png(pixels, kinds):
    """A PNG whose lines use the given filters, made by the format's definition."""
    channels, h, w = pixels.shape
    flat = pixels.transpose(1, 2, 0).reshape(h, -1).astype(int)
    lines = []
    for y, kind in enumerate(kinds):
        up = flat[y - 1] if y else np.zeros_like(flat[0])
        out = []
        for x, v in enumerate(flat[y]):
            a, b, c = (flat[y][x - channels] if x >= channels else 0), up[x], (up[x - channels] if x >= channels else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        lines.append(bytes([kind, *out]))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels):
    p = np.random.default_rng(channels).integers(0, 256, (channels, 5, 7)).astype(np.uint8)
    assert np.array_equal(P.decode_png(filtered_png(p, [0, 1, 2, 3, 4])), p)
    if channels in (1, 3):
        assert np.array_equal(P.decode_png(P.encode_png(p)), p)


def test_tiff_sets_and_sizes():
    p = np.random.default_rng(0).integers(0, 256, (3, 4, 6)).astype(np.uint8)
    body = p.transpose(1, 2, 0).tobytes()
    tags = [(256, 3, 1, 6), (257, 3, 1, 4), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 3), (279, 4, 1, len(body))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    assert np.array_equal(P.decode_tiff(b"II*\0" + struct.pack("<I", 8 + len(body)) + body + ifd), p)
    d = list(P.digits(struct.pack(">4I", 2051, 2, 2, 2) + bytes(range(8)), struct.pack(">2I", 2049, 2) + bytes([7, 1])))
    assert [(x[0], x[1], x[5]) for x in d] == [(0, 7, bytes(range(4))), (1, 1, bytes(range(4, 8)))]
    s = list(P.small_photos(bytes([3]) + bytes(range(12)) + bytes([1]) + bytes(12), 2, 3))
    assert [(x[1], x[5]) for x in s] == [(3, bytes(range(12))), (1, bytes(12))]
    packed = P.pack([(1, b"\1" * 4), (0, b"\2" * 4)], 1, 2, 2)
    assert [(r[1], r[5]) for r in read_packed_images(packed)] == [(0, b"\2" * 4), (1, b"\1" * 4)]
    x = np.arange(16, dtype=np.uint8).reshape(1, 4, 4)
    assert P.resize(x, 2, 2).tolist() == [[[2, 4], [10, 12]]] and np.array_equal(P.resize(x, 4, 4), x) and P.resize(x, 8, 8).shape == (1, 8, 8)
    assert P.standardized(x, np.array([0.0]), np.array([1.0]), 1).shape == (1, 6, 6)
    assert P.decode_png(P.heat_picture(np.array([[0.0, 2.0]])))[0].tolist() == [[0, 255]]


def test_pictures_as_rows(spark, tmp_path):
    (tmp_path / "3").mkdir()
    p = np.random.default_rng(0).integers(0, 256, (1, 4, 4)).astype(np.uint8)
    (tmp_path / "3" / "a.png").write_bytes(P.encode_png(p))
    (tmp_path / "3" / "notes.txt").write_text("no picture")
    df = P.read_pictures(spark, str(tmp_path), r"/(\d+)/[^/]*$")
    (row,) = df.collect()
    assert (row["class"], row["height"], bytes(row["data"])) == (3, 4, p.tobytes())
    assert P.resized(df, 2, 2).collect()[0]["width"] == 2


def test_natural_order(spark):
    df = spark.createDataFrame([("run_10",), ("run_2",), ("run_1b",), ("a",)], "n string")
    assert [r["n"] for r in df.orderBy(natural_key(F.col("n"))).collect()] == ["a", "run_1b", "run_2", "run_10"]
