"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters occurs in a document if a passage is within k edits of
it, k = floor(error * m).  By the q-gram lemma such a passage shares at least
m - q + 1 - k * q q-grams with the item, on diagonals that differ by at most k.
Shared q-grams are counted in overlapping bands of 2 * (k + 1) diagonals, bands
that reach the bound are kept, and banded alignment of the item with the kept
region gives the edit distance and the passage.

Items are the query set: they go to the executors in blocks of bounded size, one
block at a time, and every block meets every whole text.  Upper case A-Z equals
lower case, and any of the six ASCII spaces equals a blank.  Short items have
shorter q-grams, so that the bound is 1 at least with all their edits; items of
fewer than Q characters are too short to be a passage and match nothing.

Cases: null and empty texts and items match nothing; repeated rows and items
match row by row; null ids are passed on; extra columns are ignored or passed
on; an empty table of either kind gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from docloom.llm import textops as T
from docloom.llm.shared import written

Q, ERROR = 8, 0.1
#: Characters of items in a block at most (one item at least).
BLOCK = 1 << 22
TABLE_BITS = 22


def budget(m: int, error: float = ERROR) -> int:
    """Edits allowed for an item of m characters."""
    return int(error * m + 1e-9)


def gram_size(m: int, error: float = ERROR) -> int:
    """Characters of the q-grams of an item of m characters: the lemma's bound m - q + 1 - k * q stays 1 at least."""
    return max(1, min(Q, m // (budget(m, error) + 1)))


def folded(buf: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, A-Z as a-z and ASCII spaces as blanks."""
    c = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = np.where((c >= 65) & (c <= 90), c + 32, c)
    return np.where((c >= 9) & (c <= 13), 32, c).astype(np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position on."""
    n = len(c)
    if n < q:
        return np.zeros(0, T.U64)
    power, inverse = T.powers(n + 1)
    prefix = np.zeros(n + 1, T.U64)
    np.cumsum((c.astype(T.U64) + T.U64(1)) * T.U64(0xD6E8FEB86659FD93) * power[:n], out=prefix[1:])
    h = (prefix[q:] - prefix[:-q]) * inverse[: n - q + 1]
    return (h ^ (h >> T.U64(32))) * T.U64(T._ODD)


@dataclass
class Block:
    """Items with the sorted hashes of their q-grams and, for each hash, the (item, position) list."""

    q: int
    ids: list
    texts: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    at: np.ndarray
    table: np.ndarray


def index(ids: list, texts: list[str], q: int, error: float) -> Block:
    codes = [folded(np.frombuffer((t or "").encode(), np.uint8)) for t in texts]
    all_h = [grams(c, q) for c in codes]
    h = np.concatenate([*all_h, np.zeros(0, T.U64)])
    item = np.repeat(np.arange(len(codes)), [len(x) for x in all_h])
    at = np.concatenate([*(np.arange(len(x)) for x in all_h), np.zeros(0, np.int64)])
    by = np.argsort(h, kind="stable")
    hashes, first = np.unique(h[by], return_index=True)
    edits = np.array([budget(len(c), error) for c in codes], np.int64)
    need = np.array([len(c) for c in codes], np.int64) - q + 1 - edits * q
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(hashes >> T.U64(64 - TABLE_BITS)).astype(np.int64)] = True
    return Block(q, ids, codes, edits, need, hashes, np.append(first, len(h)), item[by], at[by].astype(np.int64), table)


def regions(c: np.ndarray, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(item, lowest diagonal) of the bands in which the shared q-grams reach the lemma's bound."""
    h = grams(c, b.q)
    pos = np.flatnonzero(b.table[(h >> T.U64(64 - TABLE_BITS)).astype(np.int64)])
    g = h[pos]
    k = np.minimum(np.searchsorted(b.hashes, g), max(len(b.hashes) - 1, 0))
    hit = b.hashes[k] == g if len(b.hashes) else np.zeros(len(g), bool)
    pos, k = pos[hit], k[hit]
    n = b.bounds[k + 1] - b.bounds[k]
    counted: list[np.ndarray] = []
    left = 0
    step = np.append(0, np.cumsum(n))
    while left < len(k):  # a bounded number of (q-gram, item position) pairs at a time, each band's count summed afterwards
        right = max(left + 1, int(np.searchsorted(step, step[left] + (1 << 22), "right")) - 1)
        nn = n[left:right]
        take = np.repeat(b.bounds[k[left:right]] - np.append(0, np.cumsum(nn))[:-1], nn) + np.arange(nn.sum())
        item = b.item[take]
        diagonal = np.repeat(pos[left:right], nn) - b.at[take] + (1 << 20)
        band = diagonal // (b.edits[item] + 1)
        key = item << 40 | band
        counted.append(np.stack(np.unique(np.concatenate([key, key - 1]), return_counts=True)))
        left = right
    if not counted:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate([x[0] for x in counted])
    count = np.concatenate([x[1] for x in counted])
    key, place = np.unique(key, return_inverse=True)
    total = np.bincount(place, count)
    item = key >> 40
    keep = total >= b.need[item]
    item, band = item[keep], key[keep] & ((1 << 40) - 1)
    return item, band * (b.edits[item] + 1) - (1 << 20)


def aligned(items: list[np.ndarray], texts: list[np.ndarray], width: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of each item to a passage of its text, and where the passage ends (the first such place).

    Row i of the alignment covers the diagonals 0 .. width of the text.  The
    passage begins on any of them, or at ``start``.  Negative codes match nothing.
    All pairs are aligned at once, a row of each in every step.
    """
    n, most, wide = len(items), max(map(len, items)), int(width.max()) + 1
    length = np.array([len(x) for x in items])
    pattern = np.zeros((n, most), np.int64)
    text = np.full((n, most + wide + 1), -1, np.int64)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        pattern[i, : len(x)] = x
        y = y[: text.shape[1]]
        text[i, : len(y)] = y
    size = np.array([len(y) for y in texts])[:, None]
    d = np.arange(wide)
    big = 1 << 20
    row = np.zeros((n, wide), np.int64) if start is None else np.where(d >= start[:, None], d - start[:, None], big)
    row = np.where((d <= width[:, None]) & (d <= size), row, big)
    out, end = np.full(n, big), np.zeros(n, np.int64)
    for i in range(most + 1):
        if i:
            diagonal = row + (text[:, i - 1 : i - 1 + wide] != pattern[:, i - 1 : i])
            above = np.full_like(row, big)
            above[:, :-1] = row[:, 1:] + 1
            row = np.minimum(diagonal, above)
            row = np.where((d <= width[:, None]) & (d + i <= size), row, big)
            row = np.minimum.accumulate(row - d, axis=1) + d
            row = np.where((d <= width[:, None]) & (d + i <= size), row, big)
        done = length == i
        if done.any():
            out[done] = row[done].min(1)
            end[done] = row[done].argmin(1) + i
    return out, end


def _search(c: T.Chunk, b: Block) -> list[tuple[int, int, int, int, int]]:
    """Best (row of the chunk, item, edits, start, end) for each pair that matches."""
    code = folded(c.buf)
    offs = np.append(0, np.cumsum((c.buf & 0xC0) != 0x80))[c.offs]
    item, low = regions(code, b)
    pairs = []
    for x, lo in zip(item.tolist(), low.tolist(), strict=True):
        k, m = int(b.edits[x]), len(b.texts[x])
        lo, hi = lo - k, lo + 2 * (k + 1) - 1 + m + k  # the band's diagonals and k more on either side
        first, last = np.searchsorted(offs, max(lo, 0), "right") - 1, np.searchsorted(offs, hi, "left")
        for doc in range(max(int(first), 0), min(int(last), len(offs) - 1)):
            begin, stop = max(lo, int(offs[doc])), min(hi, int(offs[doc + 1]))
            if stop - begin >= m - k:
                text = np.append(np.full(begin - lo, -1, np.int64), code[begin:stop])
                pairs.append((x, doc, lo, text, 4 * k + 1))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in range(0, len(pairs), 256):
        some = pairs[i : i + 256]
        edits, end = aligned([b.texts[x] for x, *_ in some], [t for *_, t, _ in some], np.array([w for *_, w in some]))
        good = [(*p, int(e), int(s)) for p, e, s in zip(some, edits, end, strict=True) if e <= b.edits[p[0]]]
        if not good:
            continue
        # backwards from where it ends, to find where it starts
        most = b.edits[[p[0] for p in good]]
        back = [np.append(np.full(k, -1, np.int64), p[3][: p[6]][::-1]) for p, k in zip(good, most, strict=True)]
        _, size = aligned([b.texts[p[0]][::-1] for p in good], back, 2 * most, most)
        for (x, doc, lo, _, _, e, s), n, k in zip(good, size.tolist(), most.tolist(), strict=True):
            at = lo + s - int(offs[doc])
            found = (e, max(at - (n - k), 0), at)
            best[doc, x] = min(best.get((doc, x), found), found)
    return [(doc, x, *v) for (doc, x), v in best.items()]


def _blocks(items: DataFrame, error: float, size: int) -> Iterator[list[Block]]:
    """Indexes of the items, one for each q, of about ``size`` characters at a time.  The items pass through the driver, a block at a time."""
    found: dict[int, tuple[list, list]] = {}
    total = 0
    for r in items.select("item_id", "text").toLocalIterator():
        m = len(r[1] or "")
        if m < Q:
            continue
        if found and total + m > size:
            yield [index(*x, q, error) for q, x in found.items()]
            found, total = {}, 0
        ids, texts = found.setdefault(gram_size(m, error), ([], []))
        ids.append(r[0])
        texts.append(r[1])
        total += m
    yield [index(*x, q, error) for q, x in found.items()]


def contaminated(docs: DataFrame, items: DataFrame, error: float = ERROR, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits and passage (start, end in code points of the text) for every document and item that match; the best passage of each."""
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    item_kind = to_arrow_type(items.schema["item_id"].dataType)

    def scan(shared):  # noqa: ANN001, ANN202
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in T.chunks(batch.column(1), 1 << 21):
                    for b in shared.value:
                        if found := _search(c, b):
                            doc, item, *rest = zip(*found, strict=True)
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(doc) + c.lo)), pa.array([b.ids[x] for x in item], item_kind), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "edits", "start", "end"])

        return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long, start long, end long")

    out, blocks = None, _blocks(items, error, block)
    now, after = next(blocks), next(blocks, None)
    while after is not None:  # each block's matches are kept before the next block is sent
        shared = spark.sparkContext.broadcast(now)
        found = written(scan(shared), "matches")
        shared.destroy()
        out = found if out is None else out.union(found)
        now, after = after, next(blocks, None)
    last = scan(spark.sparkContext.broadcast(now))
    return last if out is None else out.union(last)


def decontamination_stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item; columns unchanged.  Rows are judged by their text alone, whatever their doc_id."""
    spark = docs.sparkSession
    out = docs

    def clean_of(shared, packed: DataFrame) -> DataFrame:  # noqa: ANN001
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in T.chunks(batch.column(1), 1 << 21):
                    keep = np.ones(c.hi - c.lo, bool)
                    for b in shared.value:
                        for doc, *_ in _search(c, b):
                            keep[doc] = False
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo).filter(pa.array(keep))], ["row"])

        return packed.mapInArrow(clean, StructType([packed.schema["row"]])).select("row.*")

    blocks = _blocks(items, ERROR, BLOCK)
    now = next(blocks)
    while now is not None:
        shared, after = spark.sparkContext.broadcast(now), next(blocks, None)
        out = clean_of(shared, out.select(F.struct(*[out[c] for c in out.columns]).alias("row"), out["text"].alias("text")))
        if after is not None:
            out = written(out, "clean")
            shared.destroy()
        now = after
    return out


def op7_qgram_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every (document, benchmark item) pair within a tenth of the item's length in edits."""
    return contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"))
