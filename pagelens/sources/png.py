"""PNG images: header by columns, pixels by numpy; 8-bit RGB or RGBA without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def header(image: Column) -> Column:
    """struct(width, height) from the bytes 16 to 23 of a PNG, null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(image, at, 4)), 16, 10).cast("int")
    is_png = (F.octet_length(image) >= 24) & (F.hex(F.substring(image, 1, 8)) == SIGNATURE.hex().upper())
    return F.when(is_png, F.struct(number(17).alias("width"), number(21).alias("height")))


def data_url(image: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(image))


def from_data_url(url: Column) -> Column:
    """The bytes of a base64 data URL, null for other texts."""
    return F.when(F.startswith(url, F.lit("data:")) & F.contains(url, F.lit(";base64,")), F.unbase64(F.substring_index(url, ";base64,", -1)))


def encode(pixels: np.ndarray) -> bytes:
    """PNG of an (h, w, 4) array of bytes."""
    h, w = pixels.shape[:2]
    raw = np.zeros((h, w * 4 + 1), np.uint8)
    raw[:, 1:] = pixels.reshape(h, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def decode(image: bytes | None, longest: int | None = 960) -> np.ndarray | None:
    """(h, w, 4) bytes of a PNG, scaled down by whole steps to `longest`; None if it can't be read."""
    if not image or image[:8] != SIGNATURE:
        return None
    try:
        at, data, w, h, channels = 8, b"", 0, 0, 4
        while at < len(image):
            (size,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
            body = image[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
                if depth != 8 or colour not in (2, 6) or interlace:
                    return None
                channels = 4 if colour == 6 else 3
            elif kind == b"IDAT":
                data += body
            at += 12 + size
        rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w * channels + 1)
    except (struct.error, zlib.error, ValueError):
        return None
    out = np.zeros((h, w * channels), np.int64)
    above = np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(w, channels), axis=0).reshape(-1) % 256
        elif kind == 2:
            line = (line + above) % 256
        elif kind in (3, 4):
            done = np.zeros(w * channels + channels, np.int64)
            up = np.concatenate([np.zeros(channels, np.int64), above])
            for i in range(w * channels):
                a, b, c = done[i], up[i + channels], up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[i + channels] = (line[i] + guess) % 256
            line = done[channels:]
        out[y] = above = line
    pixels = out.reshape(h, w, channels).astype(np.uint8)
    if channels == 3:
        pixels = np.concatenate([pixels, np.full((h, w, 1), 255, np.uint8)], axis=2)
    if longest and max(h, w) > longest:
        scale = longest / max(h, w)
        ys = np.minimum(h - 1, (np.arange(max(1, round(h * scale))) / scale).astype(int))
        xs = np.minimum(w - 1, (np.arange(max(1, round(w * scale))) / scale).astype(int))
        pixels = pixels[ys][:, xs]
    return pixels
