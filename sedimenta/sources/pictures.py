"""Facts of pictures read from their bytes: kind, resolution, and the variances of a thumbnail's channels.

Headers of PNG, GIF, BMP, JPEG and WebP give the resolution. Pixels are read from PNG files of 8 bits a channel without
interlacing and from BMP files of 24 or 32 bits; other pictures have no variances and are never taken for solid colours.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.sources import recognition

#: Side of the thumbnail of which the channels' variances are taken.
SIDE = 10


def size(data: bytes) -> tuple[int, int] | None:
    """(width, height), or None if the bytes are no picture of a known kind."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + length
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8 ":
            width, height = struct.unpack("<HH", data[26:30])
            return width & 0x3FFF, height & 0x3FFF
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None


def _png(data: bytes) -> np.ndarray | None:
    width, height, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or woven or channels is None:
        return None
    at, packed = 8, b""
    while at + 8 <= len(data):
        length = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + length]
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.int32)
    before = np.zeros((width, channels), np.int32)
    for y in range(height):
        kind, raw = rows[y, 0], rows[y, 1:].reshape(width, channels).astype(np.int32)
        if kind == 1:
            raw = np.cumsum(raw, axis=0) & 255
        elif kind == 2:
            raw = (raw + before) & 255
        elif kind > 2:
            for x in range(width):
                left = raw[x - 1] if x else np.zeros(channels, np.int32)
                corner = before[x - 1] if x else np.zeros(channels, np.int32)
                if kind == 3:
                    guess = (left + before[x]) // 2
                else:
                    a, b, c = np.abs(before[x] - corner), np.abs(left - corner), np.abs(left + before[x] - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, before[x], corner))
                raw[x] = (raw[x] + guess) & 255
        out[y] = before = raw
    return np.repeat(out[:, :, :1], 3, axis=2) if channels < 3 else out[:, :, :3]


def _bmp(data: bytes) -> np.ndarray | None:
    start = int.from_bytes(data[10:14], "little")
    width, height = struct.unpack("<ii", data[18:26])
    bits, packing = struct.unpack("<HI", data[28:34])
    if bits not in (24, 32) or packing not in (0, 3):
        return None
    row = (width * bits // 8 + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    return pixels[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def variances(data: bytes) -> list[float] | None:
    """Population variances of red, green and blue in a thumbnail of cell means; None where pixels can't be read."""
    try:
        pixels = _png(data) if data[:4] == b"\x89PNG" else _bmp(data) if data[:2] == b"BM" else None
    except (ValueError, struct.error, zlib.error, IndexError):
        return None
    if pixels is None or not pixels.size:
        return None
    edges = [np.unique(np.linspace(0, n, min(n, SIDE) + 1).astype(int)) for n in pixels.shape[:2]]
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.float64), edges[0][:-1], axis=0), edges[1][:-1], axis=1)
    cells = np.outer(np.diff(edges[0]), np.diff(edges[1]))[:, :, None]
    return np.round((sums / cells).reshape(-1, 3), 0).var(axis=0).tolist()


def picture_facts(files: DataFrame) -> DataFrame:
    """``path, length, width, height, variances`` of pictures (``path, content``); nulls where bytes can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                data = None if content is None else bytes(content)
                found = size(data) if data else None
                rows.append((path, None if data is None else len(data), *(found or (None, None)), variances(data) if found else None))
            frame = pd.DataFrame(rows, columns=["path", "length", "width", "height", "variances"])
            yield frame.astype({"length": "Int64", "width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, length long, width long, height long, variances array<double>")


def judged(files: DataFrame, min_bytes: int = 500, min_pixels: int = 50) -> DataFrame:
    """``path, keep, reason``: whether pictures are worth recognising."""
    f = F.col
    verdict = recognition.worth_recognising(f("length"), f("width"), f("height"), f("variances"), min_bytes, min_pixels)
    return picture_facts(files).select("path", verdict.alias("v")).select("path", "v.*")


def worth(files: DataFrame, min_bytes: int = 500, min_pixels: int = 50) -> DataFrame:
    """The pictures worth recognising, with all their columns."""
    return files.join(judged(files, min_bytes, min_pixels).filter("keep").select("path").distinct(), "path", "left_semi")


def reasons(verdicts: DataFrame) -> DataFrame:
    """``reason, pictures`` of what was left out."""
    return verdicts.filter("NOT keep").groupBy("reason").agg(F.count("*").alias("pictures"))
