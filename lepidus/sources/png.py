"""Greyscale PNG of masks, in the parts of the format that they need."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(grey: np.ndarray) -> bytes:
    """PNG of uint8[height, width]."""
    h, w = grey.shape
    rows = np.zeros((h, w + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = grey
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def decode(content: bytes) -> np.ndarray:
    """uint8[height, width] of what encode() made."""
    w, h = struct.unpack(">II", content[16:24])
    at, data = 8, b""
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        data += content[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w + 1)[:, 1:]


def mask(runs: list[tuple[int, int, int]], height: int | None = None, width: int | None = None) -> np.ndarray:
    """0 and 255 of pixel runs (y, x0, x1), from the picture's corner; cut off at its edges, or just large enough."""
    height = max((r[0] + 1 for r in runs), default=1) if height is None else height
    width = max((r[2] + 1 for r in runs), default=1) if width is None else width
    out = np.zeros((height, width), np.uint8)
    for y, x0, x1 in runs:
        if 0 <= y < height and x1 >= 0:
            out[y, max(0, x0) : x1 + 1] = 255
    return out
