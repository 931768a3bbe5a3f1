"""Images as they are returned: within the long edge and the byte cap.

The standard library decodes PNG only, so PNG images (8 bits, not interlaced)
are scaled and re-encoded here; images of other formats are returned as they
are if they are within the caps, and skipped otherwise.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from docloom.contract import Limits
from docloom.functions import raw

CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/webp": ".webp", "image/tiff": ".tif"}


@dataclass
class Normalized:
    data: bytes
    mime: str
    extension: str
    width: int
    height: int
    downscaled: bool


def normalized(data: bytes, limits: Limits) -> tuple[Normalized | None, str]:
    """The image within the caps, or why it is skipped."""
    mime, (w, h) = raw.image_mime(data) or "", raw.image_size(data) or (0, 0)
    edge = max(w, h)
    if mime != "image/png":
        if edge > limits.image_edge:
            return None, "resize failed"
        if len(data) > limits.image_bytes:
            return None, "encoded image exceeds 3.75 MB"
        return Normalized(data, mime, EXTENSIONS[mime], w, h, False), ""
    if edge <= limits.image_edge and len(data) <= limits.image_bytes:
        try:
            intact = _chunks(data)[-1][0] == b"IEND"
        except (struct.error, IndexError):
            intact = False
        return (Normalized(data, mime, ".png", w, h, False), "") if intact else (None, "decode failed")
    try:
        pixels = decode_png(data)
    except (ValueError, zlib.error, struct.error, IndexError):
        return None, "decode failed"
    if edge > limits.image_edge:
        pixels = resized(pixels, *(max(1, round(x * limits.image_edge / edge)) for x in (w, h)))
    for _ in range(6):
        out = encode_png(pixels)
        if len(out) <= limits.image_bytes:
            return Normalized(out, mime, ".png", pixels.shape[1], pixels.shape[0], True), ""
        small = max(1, int(pixels.shape[1] * 0.75)), max(1, int(pixels.shape[0] * 0.75))
        if small == pixels.shape[1::-1]:
            break
        pixels = resized(pixels, *small)
    return None, "encoded image exceeds 3.75 MB"


def _chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + n > len(data):
            break
        out.append((kind, data[at + 8 : at + 8 + n]))
        at += 12 + n
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of 8 bits."""
    chunks = _chunks(data)
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    if depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError("PNG variant")
    n = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(c for k, c in chunks if k == b"IDAT")), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w, n), np.uint8), np.zeros((w, n), np.uint8)
    for y in range(h):
        kind, row = lines[y, 0], lines[y, 1:].reshape(w, n)
        if kind == 1:
            row = np.cumsum(row, axis=0, dtype=np.uint8)
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            made, left, corner = np.zeros((w, n), np.int16), np.zeros(n, np.int16), np.zeros(n, np.int16)
            for x in range(w):
                up = above[x].astype(np.int16)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (row[x] + guess) & 255, up
                made[x] = left
            row = made.astype(np.uint8)
        elif kind:
            raise ValueError("PNG filter")
        out[y] = above = row
    return out


def encode_png(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = next(k for k, v in CHANNELS.items() if v == n)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def resized(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear."""

    def axis(a: np.ndarray, n: int) -> np.ndarray:
        at = np.clip((np.arange(n) + 0.5) * len(a) / n - 0.5, 0, len(a) - 1)
        low = at.astype(int)
        part = (at - low).reshape(-1, *[1] * (a.ndim - 1))
        return a[low] * (1 - part) + a[np.minimum(low + 1, len(a) - 1)] * part

    tall = axis(pixels.astype(float), h)
    return np.clip(np.rint(axis(tall.swapaxes(0, 1), w).swapaxes(0, 1)), 0, 255).astype(np.uint8)
