"""Vectorised text primitives over Arrow string buffers.

Every function works on a *chunk*: the UTF-8 bytes of consecutive texts with
their offsets, so that one numpy call serves thousands of documents.  A null
text is an empty text.  Whole texts only: a text is never split over chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts in a chunk at most.
MOST_TEXTS = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


class Chunk(NamedTuple):
    """Rows ``lo:hi`` of a batch: bytes ``buf``, text ``i`` at ``offs[i]:offs[i + 1]``."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray


class Words(NamedTuple):
    """Words of a chunk in order: text number, byte span, 64-bit hash; ``prefix`` are the running byte hashes."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray
    space: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (a bijection of 64-bit words)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_pow[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_ODD, _INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _pow[k] = np.cumprod(table, dtype=U64)
    return _pow[0], _pow[1]


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``limit`` bytes, whole texts each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, min(int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1, lo + MOST_TEXTS))
        yield Chunk(lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def spaces(buf: np.ndarray) -> np.ndarray:
    """True at bytes 0x20 and 0x09-0x0D."""
    return (buf == 32) | ((buf - np.uint8(9)) < 5)


def words(c: Chunk, fold: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; ``fold`` hashes A-Z as a-z."""
    n = len(c.buf)
    power, inverse = powers(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((_FOLD if fold else _BYTE)[c.buf] * power[:n], out=prefix[1:])
    space = spaces(c.buf)
    first = np.zeros(n + 1, bool)
    first[c.offs] = True
    begins = ~space
    begins[1:] &= space[:-1] | first[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(c.offs, start, "right") - 1
    return Words(doc, start, end, span_hash(prefix, start, end, inverse), prefix, space)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray | None = None) -> np.ndarray:
    """Hash of byte spans from running hashes: equal bytes have equal hashes wherever they stand."""
    inverse = powers(len(prefix))[1] if inverse is None else inverse
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all runs of ``k`` words within one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = w.hash[:n].copy()
    for i in range(1, k):
        h = h * U64(_ODD) + w.hash[i : i + n]
    same = w.doc[:n] == w.doc[k - 1 :]
    return w.doc[:n][same], mix(h[same])


def lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of each text's lines, without their newlines; an empty line at a text's end is left out."""
    n = len(c.buf)
    cut = np.zeros(n + 1, bool)
    cut[1:] = c.buf == 10
    cut[c.offs[:-1]] = True
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)[: len(start)]
    doc = np.searchsorted(c.offs, start, "right") - 1
    return doc, start, end - (c.buf[end - 1] == 10)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for every i."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def bounds_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Row bounds of each text in a column sorted by text number."""
    return np.searchsorted(doc, np.arange(n + 1))
