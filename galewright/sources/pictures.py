"""Pictures: PNG and plain TIFF files as arrays of pixels, the packed data sets of handwritten digits and small photos, resizing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, image int, class int, channels int, height int, width int, data binary"


def decode_png(data: bytes) -> np.ndarray:
    """(channels, height, width) of an 8-bit grey, grey-alpha, RGB or RGBA picture without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    width, height, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only 8-bit pictures without palette and interlacing")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    zero = np.zeros(width * channels, np.int32)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else zero
        if kind == 1:  # each byte is a difference to the one a pixel before: a running sum per channel
            line = np.cumsum(line.reshape(width, channels), 0).reshape(-1)
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):
            for x in range(len(line)):
                left = int(line[x - channels]) & 255 if x >= channels else 0
                above, corner = int(up[x]), int(up[x - channels]) if x >= channels else 0
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((left, above, corner), key=lambda v: (abs(p - v), (left, above, corner).index(v)))
                line[x] = (line[x] + guess) & 255
        out[y] = line & 255
    return out.reshape(height, width, channels).transpose(2, 0, 1)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of (channels, height, width) with 1 or 3 channels of bytes."""
    channels, height, width = pixels.shape
    rows = np.zeros((height, 1 + width * channels), np.uint8)
    rows[:, 1:] = pixels.transpose(1, 2, 0).reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_tiff(data: bytes) -> np.ndarray:
    """(channels, height, width) of an uncompressed 8-bit TIFF in strips."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
        if size:
            place = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("only uncompressed pictures")
    width, height, channels = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    raw = b"".join(data[a : a + c] for a, c in zip(tags[273], tags[279]))
    return np.frombuffer(raw, np.uint8).reshape(height, width, channels).transpose(2, 0, 1)


def decode(name: str, data: bytes) -> np.ndarray:
    return decode_png(data) if name.lower().endswith(".png") else decode_tiff(data)


def read_pictures(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """One row per PNG or TIFF file below ``path``. ``label`` is a regular expression whose first group in the path is the class."""
    import re

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in zip(b["path"], b["content"]):
                p = decode(name, bytes(content))
                found = re.search(label, name) if label else None
                out.append((name, 0, int(found[1]) if found else -1, *p.shape, p.tobytes()))
            yield pd.DataFrame(out, columns=["path", "image", "class", "channels", "height", "width", "data"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("lower(path) RLIKE '[.](png|tiff?)$'")
    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def digits(images: bytes, labels: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(index, class, channels, height, width, pixels) of a set of handwritten digits in its two big-endian files."""
    _, n, height, width = struct.unpack_from(">4I", images, 0)
    for k in range(n):
        yield k, labels[8 + k], 1, height, width, images[16 + k * height * width : 16 + (k + 1) * height * width]


def small_photos(data: bytes, side: int = 32, channels: int = 3) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """The same of a set of records of one class byte and the planes of a photo."""
    step = 1 + channels * side * side
    for k in range(len(data) // step):
        yield k, data[k * step], channels, side, side, data[k * step + 1 : (k + 1) * step]


def pack(rows: list[tuple[int, bytes]], channels: int, height: int, width: int) -> bytes:
    """The packed form that `operators.images.read_packed_images` reads: images go by class."""
    classes = max(c for c, _ in rows) + 1
    sizes = [sum(c == k for c, _ in rows) for k in range(classes)]
    return struct.pack(f"<4i{classes}i", classes, channels, width, height, *sizes) + b"".join(d for k in range(classes) for c, d in rows if c == k)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean of the pixels it covers, or the nearest one where it covers none."""
    channels, h, w = pixels.shape
    ys, xs = (np.arange(height + 1) * h) // height, (np.arange(width + 1) * w) // width
    sums = np.zeros((channels, h + 1, w + 1))
    sums[:, 1:, 1:] = pixels.astype(float).cumsum(1).cumsum(2)
    y1, x1 = np.maximum(ys[1:], ys[:-1] + 1), np.maximum(xs[1:], xs[:-1] + 1)
    y0, x0 = ys[:-1], xs[:-1]
    box = sums[:, y1][:, :, x1] - sums[:, y0][:, :, x1] - sums[:, y1][:, :, x0] + sums[:, y0][:, :, x0]
    return np.rint(box / ((y1 - y0)[:, None] * (x1 - x0)[None, :])).astype(np.uint8)


def resized(df: DataFrame, height: int, width: int) -> DataFrame:
    """A frame of pictures at another size."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b["data"] = [resize(np.frombuffer(bytes(d), np.uint8).reshape(c, h, w), height, width).tobytes() for d, c, h, w in zip(b["data"], b["channels"], b["height"], b["width"])]
            b["height"], b["width"] = height, width
            yield b

    return df.mapInPandas(rows, df.schema)


def standardized(pixels: np.ndarray, mean: np.ndarray, sd: np.ndarray, padding: int = 0) -> np.ndarray:
    """(x / 255 - mean) / sd per channel, with a border of zeros."""
    out = (pixels / 255.0 - mean[:, None, None]) / sd[:, None, None]
    return np.pad(out, [(0, 0), (padding, padding), (padding, padding)])


def heat_picture(heat: np.ndarray) -> bytes:
    """A heat map as a grey PNG, the greatest value white."""
    top = heat.max() if heat.size and heat.max() > 0 else 1.0
    return encode_png(np.clip(np.rint(heat / top * 255), 0, 255).astype(np.uint8)[None])
