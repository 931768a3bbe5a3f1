"""Line dedup: exact set-similarity join over the lines of all documents.

A line's set is its distinct words (A-Z lower-cased); lines without a word are
never removed.  A line is removed if an earlier line, in order of (doc_id, hash
of the text, line number), has Jaccard similarity of at least ``threshold`` with it.

1. Word frequencies over all texts go to a table of fixed size; (frequency
   slot, hash) is the one order of rarity that all lines share.
2. Equal sets are grouped by a 128-bit hash; only each set's first line goes on,
   and gets a number in that order.
3. Star step: lines that share one of a few pairs of min-hashes are often much
   alike.  They are held against the earliest of each of a few parts of them, and
   those that may match and don't against the earliest of more parts.  What matches
   is settled, so a large group of near copies costs a few comparisons each,
   whatever line comes first in it.
4. The rest is the exact join: the prefixes (rarest words) of unsettled lines
   against those of all lines, under length, positional and bitmap filters; the
   bitmap has 64 bits, and 128 for lines of WIDE words, which would fill 64.
   Postings are dealt out by word in packed blocks, in one shuffle, and joined in
   order of (word, size); the shorter line of a pair needs a shorter prefix.  A
   word of more than HOT postings is cut into blocks, and all pairs of blocks that
   may match are dealt out anew.
5. Candidates are verified on the full word sets; in the join, each line's
   likeliest candidate is tried before all the others.

Cases: null and empty texts have no lines with a word; rows with the same
doc_id, null included, are judged each by its own text; rows equal in doc_id and
text are one document and get the same decisions; null ids come first; extra
columns are ignored or passed on; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import textops as T
from docloom.llm.shared import dropped, record, written

#: Size of the table of word frequencies, and of the filter of wanted lines (both as powers of two).
FREQ_BITS, WANT_BITS = 20, 24
#: Bits by which words of lines are told apart.
HASH_BITS = 50
#: Pairs of min-hashes of a line, and parts of the lines that share one in the first and second round.
STAR_KEYS, PARTS = 2, (4, 32)
#: Words of a line from which on its bitmap has a second half.
WIDE = 96
#: A word's postings beyond which pairs of their blocks are dealt out, postings that a task deals out at a time, and pairs that it looks at.
HOT, HELD, PAIRS = 1 << 14, 1 << 20, 1 << 17
#: A word of a line's prefix: the line's size, id and bitmaps; ``at`` is twice the word's place in the prefix, and 1 more if the line is settled.
POSTING = np.dtype([("key", "<u4"), ("n", "<u4"), ("id", "<i8"), ("bitmap", "<u8"), ("wide", "<u8"), ("at", "<u4")])
#: Slots of word frequencies that are counted in one row.
FREQ_ROW = 1 << 12
#: Frequencies are told apart up to here.
MOST_FREQ = (1 << 20) - 1
#: Odd factors of the min-hashes, two for each pair.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> T.U64(64 - bits)).astype(np.int64)


def word_frequencies(docs: DataFrame) -> np.ndarray:
    """Occurrences of words by hash slot, over every text: an array of 2**FREQ_BITS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQ_BITS, np.int64)
        for b in batches:
            for c in T.chunks(b.column(0)):
                total += np.bincount(_slot(T.words(c, True).hash, FREQ_BITS), minlength=len(total))
        yield from rows({i: total[i * FREQ_ROW : (i + 1) * FREQ_ROW] for i in range(len(total) // FREQ_ROW)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(n, np.int32).astype(np.int64)
        yield from rows(total)

    def rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, n in total.items():
            if n.any():
                yield record("row:int n:bin", row=[i], n=[np.minimum(n, MOST_FREQ).astype(np.int32).tobytes()])

    found = docs.select("text").mapInArrow(count, "row int, n binary").repartition("row").mapInArrow(add, "row int, n binary").toArrow()
    out = np.zeros(1 << FREQ_BITS, np.int32)
    for i, n in zip(found["row"].to_pylist(), found["n"].to_pylist(), strict=True):
        out[i * FREQ_ROW : (i + 1) * FREQ_ROW] = np.frombuffer(n, np.int32)
    return out


def _by_line(line: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines and their values of HASH_BITS bits, sorted by both; ``line`` is ascending."""
    out = np.empty(len(value), T.U64)
    if not len(line):
        return line, out
    # line numbers have the bits that are left: blocks of lines, each numbered from 0
    edges = np.searchsorted(line, np.arange(0, int(line[-1]) + 1, 1 << (64 - HASH_BITS)))
    for lo, hi in zip(edges, [*edges[1:], len(line)], strict=True):
        if lo < hi:
            out[lo:hi] = np.sort((line[lo:hi] & ((1 << (64 - HASH_BITS)) - 1)).astype(T.U64) << T.U64(HASH_BITS) | value[lo:hi])
    return line, out & T.U64((1 << HASH_BITS) - 1)


def _sets(c: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line with a word: (text number, line number, bounds into words, words by line).

    A word is the upper HASH_BITS bits of its hash.
    """
    w = T.words(c, True)
    doc, start, _ = T.lines(c)
    line, h = np.searchsorted(start, w.start, "right") - 1, w.hash
    line, key = _by_line(line, h >> T.U64(64 - HASH_BITS))
    first = np.append(True, (line[1:] != line[:-1]) | (key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    line, key = line[first], key[first]
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    lines = line[begin]
    number = lines - np.searchsorted(doc, doc[lines])
    return doc[lines], number, np.append(begin, len(key)), key


def _cut_out(c: T.Chunk, start: np.ndarray, end: np.ndarray) -> T.Chunk:
    """The byte spans as texts of their own, so that what isn't wanted is not cut into words."""
    size = end - start
    offs = np.append(0, np.cumsum(size))
    return T.Chunk(0, len(size), c.buf[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])], offs)


def _list(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _line_hash(row_hash: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hash of a line's place, from the hash of its row and its number."""
    return T.mix(row_hash.view(T.U64) + (line.astype(T.U64) + T.U64(1)) * T.U64(T._ODD)).view(np.int64)


def _set_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit hash of each line's set, and the mixed hashes of its words."""
    mixed = T.mix(h)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), mixed
    h1, h2 = np.add.reduceat(mixed, at), np.bitwise_xor.reduceat(T.mix(mixed + T.U64(T._ODD)), at)
    return h1.view(np.int64), h2.view(np.int64), mixed


def _bitmaps(mixed: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of each line's words in 64 cells, and in one half of 128 cells, the other half being the difference; 0 for lines of fewer than WIDE words."""
    cell = T.U64(1) << (mixed >> T.U64(58))
    half = np.bitwise_xor.reduceat(cell * (mixed >> T.U64(57) & T.U64(1)), at)
    return np.bitwise_xor.reduceat(cell, at).view(np.int64), np.where(n >= WIDE, half, T.U64(0)).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, hash t of the text, and hash k of both."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t"), F.xxhash64("doc_id", F.xxhash64("text")).alias("k"))


def line_sets(docs: DataFrame, freq: np.ndarray, threshold: float, counted: bool = False) -> DataFrame:
    """For each line with a word: place (doc_id, t, line) and its hash h, size n, 128-bit hash of the set, bitmaps, min-hashes, and prefix in order of rarity.

    Min-hashes and prefix words have 32 bits: they find candidates, which are
    then verified on the words.  A prefix word that occurs once in all texts is 0.
    With ``counted`` each row of ``docs`` has a row more, without hashes, whose
    ``line`` is its number of lines (0 for null).
    """
    shared = docs.sparkSession.sparkContext.broadcast(freq)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for b in batches:
            for c in T.chunks(b.column(1)):
                if counted:
                    text = b.column(1).slice(c.lo, c.hi - c.lo)
                    n_lines = (T.sums(c.buf == 10, c.offs) + 1) * text.is_valid().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, len(text)), b.column(2).slice(c.lo, len(text)), pa.nulls(len(text), pa.int64()), pa.array(n_lines.astype(np.int32)), *[pa.nulls(len(text), k) for k in kinds]], names)
                doc, number, bounds, h = _sets(c)
                if not len(doc):
                    continue
                n, at = np.diff(bounds), bounds[:-1]
                h1, h2, mixed = _set_hashes(h, at)
                bitmap, wide = _bitmaps(mixed, at, n)
                line = np.repeat(np.arange(len(n)), n)
                rank = freq[(h >> T.U64(HASH_BITS - FREQ_BITS)).astype(np.int64)].astype(T.U64)
                _, rare = _by_line(line, rank << T.U64(HASH_BITS - FREQ_BITS) | h & T.U64((1 << (HASH_BITS - FREQ_BITS)) - 1))
                pos = np.arange(len(h)) - at[line]
                take = pos < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[line]
                word = np.maximum(T.mix(rare[take]) >> T.U64(32), 1).astype(np.uint32)
                prefix = np.where(rare[take] < T.U64(2 << (HASH_BITS - FREQ_BITS)), np.uint32(0), word).view(np.int32)
                ends = np.append(0, np.cumsum(np.bincount(line[take], minlength=len(n))))
                lows = [np.minimum.reduceat(mixed * T.U64(x), at) for x in ODD]
                both = np.stack([T.mix(x) + y for x, y in zip(lows[::2], lows[1::2], strict=True)], 1)
                stars = (T.mix(both + np.arange(STAR_KEYS, dtype=T.U64)) >> T.U64(32)).astype(np.uint32).view(np.int32).ravel()
                rows = pa.array(doc + c.lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(rows), b.column(2).take(rows), pa.array(_line_hash(b.column(3).to_numpy()[doc + c.lo], number)), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(h1), pa.array(h2), pa.array(bitmap), pa.array(wide), _list(stars, np.arange(len(n) + 1) * STAR_KEYS), _list(prefix, ends),
                    ],
                    names,
                )

    names = ["doc_id", "t", "h", "line", "n", "h1", "h2", "bitmap", "wide", "stars", "prefix"]
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int32())] * 2]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _rows(docs).mapInArrow(build, f"doc_id {kind}, t long, h long, line int, n int, h1 long, h2 long, bitmap long, wide long, stars array<int>, prefix array<int>")


def words_of_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, words) of the ``lines`` (id, place hash h, set hashes h1 and h2).

    A scan passes lines by a filter of fixed size; a join then takes the wanted sets exactly.
    """
    slots = lines.select(F.shiftrightunsigned("h", 64 - WANT_BITS).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    want = np.zeros(1 << WANT_BITS, bool)
    want[slots] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(want))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.unpackbits(shared.value).view(bool)
        for b in batches:
            for c in T.chunks(b.column(1)):
                doc, start, end = T.lines(c)
                key = _line_hash(b.column(3).to_numpy()[doc + c.lo], np.arange(len(doc)) - np.searchsorted(doc, doc))
                on = want[_slot(key.view(T.U64), WANT_BITS)]
                if not on.any():
                    continue
                _, _, bounds, h = _sets(_cut_out(c, start[on], end[on]))
                if not len(h):
                    continue
                n = np.diff(bounds)
                h1, h2, _ = _set_hashes(h, bounds[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), _list(h.view(np.int64), np.append(0, np.cumsum(n)))], ["h1", "h2", "words"])

    found = _rows(docs).mapInArrow(scan, "h1 long, h2 long, words array<long>")
    return found.join(lines.select("id", "h1", "h2"), ["h1", "h2"]).dropDuplicates(["id"]).select("id", "words")


def matched(words: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The lines b of the candidate ``pairs`` (a, b) whose Jaccard similarity reaches the threshold, by the full word sets."""
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.select("a", "b").join(words.toDF("a", "x"), "a").join(words.toDF("b", "y"), "b")
    return joined.filter(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both) - 1e-9).select(F.col("b").alias("id")).distinct()


def _words_for(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    lines = written(ends.join(sets.select("id", "h", "h1", "h2"), "id"), "candidates")
    words = written(words_of_lines(docs, lines), "line-words")
    dropped(lines)
    return words


def _near(lines: DataFrame, group: DataFrame, parts: int, threshold: float) -> DataFrame:
    """The ``lines`` (key, id, n and bitmaps) that may match an earlier line ``a``, the earliest of one of ``parts`` parts of their key's ``group``."""
    part = F.pmod(F.xxhash64("id", F.lit(parts)), F.lit(parts)).alias("part")
    # one aggregate for each column: Spark hashes those of numbers, and sorts for a struct's
    centre = group.groupBy("key", part).agg(F.min("id").alias("a"), *[F.min_by(c, "id").alias(f"c_{c}") for c in ("n", "bitmap", "wide")]).drop("part")
    found = lines.join(centre, "key").filter((F.col("a") < F.col("id")) & _may_match(F.col("c_n"), F.col("n"), "c_", "", threshold))
    return written(found.select("key", "id", "n", "bitmap", "wide", "a"), "star-pairs")


def _settled(docs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ids of the lines that match a centre of those that share a pair of min-hashes with them."""
    pairs = lambda near: near.select("a", F.col("id").alias("b")).distinct()
    star = sets.select("id", "n", "bitmap", "wide", F.explode("stars").alias("key"))
    first = _near(star, star, PARTS[0], threshold)
    words = _words_for(docs, pairs(first), sets)
    found = written(matched(words, pairs(first), threshold), "settled")
    # the rest against more of the lines that have been compared, whose words are there
    group = first.select("key", "id", "n", "bitmap", "wide").distinct()
    second = _near(group.join(found, "id", "left_anti"), group, PARTS[1], threshold)
    settled = written(found.union(matched(words, pairs(second), threshold)), "settled")
    dropped(first, words, second, found)
    return settled


def _postings(b: pa.RecordBatch) -> np.ndarray:
    """The postings of lines (id, n, bitmap, wide, gone, prefix); words that occur once have none."""
    keys = b.column(5).flatten().to_numpy().view(np.uint32)
    size = np.diff(b.column(5).offsets.to_numpy())
    line = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(keys)) - (np.cumsum(size) - size)[line]
    take = keys != 0
    out, line = np.empty(int(take.sum()), POSTING), line[take]
    out["key"], out["at"] = keys[take], 2 * pos[take] + b.column(4).to_numpy()[line]
    for i, (name, kind) in enumerate((("id", np.int64), ("n", np.uint32), ("bitmap", np.uint64), ("wide", np.uint64))):
        out[name] = b.column(i).to_numpy().view(kind)[line]
    return out


def _place(p: np.ndarray) -> np.ndarray:
    """Word and size as one number, by which postings are sorted."""
    return p["key"].astype(T.U64) << T.U64(32) | p["n"]


def _crossed(x: np.ndarray, y: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a posting of ``x`` and one of ``y`` from row ``first`` of it on, of the same word and not shorter; both are sorted."""
    n, rest = x["n"].astype(np.int64), (x["n"] - (x["at"] >> 1)).astype(np.int64)
    longest = np.minimum((n + 1e-9) / threshold + 1e-6, 2**32 - 1).astype(T.U64)
    count = np.searchsorted(_place(y), x["key"].astype(T.U64) << T.U64(32) | longest, "right") - first
    # the other line is as long at least
    on = (count > 0) & (rest >= 2 * threshold / (1 + threshold) * n - 1e-6)
    x, first, count = x[on], first[on], count[on]
    # the most that the bitmaps of a match can differ by, whatever its size
    most = np.minimum((1 - threshold) / threshold * n[on] + 1e-6, 64).astype(np.uint8)
    left, right = np.ascontiguousarray(x["bitmap"]), np.ascontiguousarray(y["bitmap"])
    ends, lo = np.cumsum(count), 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - count[lo] + PAIRS, "right")))
        some, begun = count[lo:hi], ends[lo:hi] - count[lo:hi] - (ends[lo] - count[lo])
        j = np.arange(some.sum()) + np.repeat(first[lo:hi] - begun, some)
        narrow = np.repeat(left[lo:hi], some) ^ right[j]
        d = np.bitwise_count(narrow)
        ok = np.flatnonzero(d <= np.repeat(most[lo:hi], some))
        p, q, narrow, d = x[lo + np.searchsorted(begun, ok, "right") - 1], y[j[ok]], narrow[ok], d[ok]
        lo = hi
        both, wide = p["n"].astype(np.int64) + q["n"], p["wide"] ^ q["wide"]
        common, differ = threshold / (1 + threshold) * both - 1e-9, (1 - threshold) / (1 + threshold) * both + 1e-9
        ok = (p["n"] - (p["at"] >> 1) >= common) & (q["n"] - (q["at"] >> 1) >= common) & (p["n"] >= threshold * q["n"] - 1e-9) & (d <= differ)
        ok &= (p["n"] < WIDE) | (np.bitwise_count(wide).astype(np.int64) + np.bitwise_count(narrow ^ wide) <= differ)
        # a settled line is later than none
        ok &= np.where(p["id"] < q["id"], q["at"] & 1, p["at"] & 1) == 0
        ok &= p["id"] != q["id"]
        p, q = p["id"][ok], q["id"][ok]
        if len(p):
            yield record("a:long b:long d:int x:bin y:bin", a=np.minimum(p, q), b=np.maximum(p, q), d=d[ok].astype(np.int32), x=pa.nulls(len(p), pa.binary()), y=pa.nulls(len(p), pa.binary()))


def _parted(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of open lines, and of settled ones."""
    gone = (p["at"] & 1).astype(bool)
    return p[~gone], p[gone]


def _joined(p: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs among sorted postings; two settled lines are none."""
    (u, s), find = _parted(p), np.searchsorted
    yield from _crossed(u, u, np.arange(1, len(u) + 1), threshold)
    yield from _crossed(u, s, find(_place(s), _place(u), "left"), threshold)
    yield from _crossed(s, u, find(_place(u), _place(s), "right"), threshold)


def _line_pairs(lines: DataFrame, threshold: float) -> DataFrame:
    """Candidates a < b, b open, and the distance d of their bitmaps, of ``lines`` (id, n, bitmap, wide, gone, prefix): the exact prefix join."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bucket for each partition of the shuffle, with a number that Spark deals to it, so that a task makes no more rows than shuffle blocks
    tried = spark.range(0, 16 * parts, 1, 1).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("to")).toArrow()["to"].to_numpy()
    numbers = np.unique(tried, return_index=True)[1].astype(np.int32)
    buckets = len(numbers)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(_postings(b))
            size += len(held[-1])
            if size >= HELD:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def packed(p: np.ndarray) -> pa.RecordBatch:
        bucket = (p["key"] % np.uint32(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        raw = p[np.argsort(bucket, kind="stable")].view(np.uint8)
        n = np.bincount(bucket, minlength=buckets)
        ends = np.append(0, np.cumsum(n)) * POSTING.itemsize
        data = pa.Array.from_buffers(pa.binary(), buckets, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
        return record("bucket:int postings:bin", bucket=numbers[n > 0], postings=data.take(pa.array(np.flatnonzero(n))))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.concatenate([np.zeros(0, POSTING), *[np.frombuffer(x.as_buffer(), POSTING) for b in batches for x in b.column(1)]])
        p = p[np.argsort(_place(p))]
        begin = np.flatnonzero(np.append(True, p["key"][1:] != p["key"][:-1])[: len(p)])
        size = np.diff(np.append(begin, len(p)))
        hot = size > HOT
        yield from _joined(p[~np.repeat(hot, size)], threshold)
        for lo, n in zip(begin[hot].tolist(), size[hot].tolist(), strict=True):
            blocks = [p[i : min(i + HOT // 2, lo + n)] for i in range(lo, lo + n, HOT // 2)]
            for k, x in enumerate(blocks):
                for y in blocks[k:]:
                    if y["n"][0] > (x["n"][-1] + 1e-9) / threshold + 1e-6:
                        break
                    if not ((x["at"] & 1).all() and (y["at"] & 1).all()):
                        yield record("a:long b:long d:int x:bin y:bin", a=[None], b=[None], d=[None], x=[x.tobytes()], y=[b"" if y is x else y.tobytes()])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(3), b.column(4), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), POSTING) for v in (x, y))
                if not len(y):
                    yield from _joined(x, threshold)
                    continue
                (u, s), (v, t) = _parted(x), _parted(y)
                for one, other in ((u, v), (u, t), (s, v)):
                    yield from _crossed(one, other, np.zeros(len(one), np.int64), threshold)

    kind = "a long, b long, d int, x binary, y binary"
    dealt = lines.select("id", "n", "bitmap", "wide", "gone", "prefix").mapInArrow(deal, "bucket int, postings binary").repartition("bucket")
    found = written(dealt.mapInArrow(join, kind), "postings")
    pairs, blocks = found.filter("x is null"), found.filter("x is not null")
    if not blocks.isEmpty():
        pairs = pairs.union(blocks.repartition(parts).mapInArrow(crossed, kind))
    out = written(pairs.groupBy("a", "b").agg(F.min("d").alias("d")), "line-pairs")
    dropped(found)
    return out


def removed_lines(docs: DataFrame, threshold: float = 0.8, counted: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, hash t of the text, and ``gone``, the sorted numbers of the lines that an earlier line matches, of every text that has some.

    With ``counted`` also doc_id, t and number of lines of each row.
    """
    full = written(line_sets(docs, word_frequencies(docs), threshold, counted), "line-sets")
    place = F.struct("doc_id", "t", "line")
    first = full.filter("h1 is not null").groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "t", "line", "h", "n", "bitmap", "wide", "stars", "prefix"), place).alias("s"), F.count("*").alias("copies"))
    # numbered in order: of two lines the smaller id is the earlier one
    sets = written(first.select("h1", "h2", "s.*", "copies").orderBy("doc_id", "t", "line").withColumn("id", F.monotonically_increasing_id()), "first-lines")
    mapped = written(full.select("doc_id", "t", "line", "h1", "h2"), "lines")
    dropped(full)

    settled = _settled(docs, sets, threshold)

    open_ = sets.select("id", "n", "bitmap", "wide", "prefix").join(settled.withColumn("gone", F.lit(1)).hint("merge"), "id", "left")
    pairs = _line_pairs(open_.withColumn("gone", F.coalesce("gone", F.lit(0))), threshold)
    words = _words_for(docs, pairs, sets)
    # the likeliest candidate of each line first; all others only for the lines that it doesn't settle
    best = written(pairs.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b"), "best")
    likely = written(matched(words, best, threshold), "settled")
    others = pairs.select("a", "b").join(likely.withColumnRenamed("id", "b"), "b", "left_anti").join(best, ["a", "b"], "left_anti")
    more = written(matched(words, others, threshold), "settled")
    dropped(words, best, pairs)

    # every copy of a line goes, and the first one if it has matched
    matching = sets.select("id", "doc_id", "t", "line").join(settled.union(likely).union(more).distinct().hint("merge"), "id").select("doc_id", "t", "line")
    heads = sets.filter("copies > 1").select("h1", "h2", place.alias("first"))
    copies = mapped.filter("h1 is not null").join(heads.hint("merge"), ["h1", "h2"]).filter(place > F.col("first")).select("doc_id", "t", "line")
    out = written(matching.union(copies).groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line")).alias("gone")), "removed")
    dropped(sets, settled, likely, more, *[] if counted else [mapped])
    return out, mapped.filter("h1 is null").select("doc_id", "t", F.col("line").cast("long").alias("n_lines")) if counted else None


def _may_match(n: F.Column, m: F.Column, x: str, y: str, threshold: float) -> F.Column:
    """Length filter, and the Hamming distance of the bitmaps of ``x`` and ``y`` (prefixes of columns) against the largest symmetric difference of a match."""
    most = F.lit((1 - threshold) / (1 + threshold)) * (n + m) + 1e-9
    narrow, wide = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("bitmap", "wide"))
    sizes = (n >= F.lit(threshold) * m - 1e-9) & (m >= F.lit(threshold) * n - 1e-9)
    return (F.bit_count(narrow) <= most) & sizes & ((n < WIDE) | (m < WIDE) | (F.bit_count(wide) + F.bit_count(narrow.bitwiseXOR(wide)) <= most))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with the matched lines cut from ``text``; other columns unchanged, ``n_chars`` recounted if there.

    A text that loses all its lines becomes empty; a null text stays null.
    """
    table, _ = removed_lines(docs.select("doc_id", "text"), threshold)
    gone = table["gone"]
    out = docs.join(table.hint("merge"), docs["doc_id"].eqNullSafe(table["doc_id"]) & (F.xxhash64(docs["text"]) == table["t"]), "left")
    # the lines are bound once for each text, and the numbers that stay are a difference of sets: linear time at any number of lines
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    cut = F.transform(F.array(F.split(docs["text"], "\n", -1)), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))[0]
    out = out.select(F.when(gone.isNull(), docs["text"]).otherwise(cut).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return out.select(*[F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_line_dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: its number of lines (0 for null), of lines removed, and their numbers in order."""
    table, counted = removed_lines(docs.select("doc_id", "text"), threshold, counted=True)
    out = counted.join(table.hint("merge"), counted["doc_id"].eqNullSafe(table["doc_id"]) & (counted["t"] == table["t"]), "left")
    removed = F.coalesce(table["gone"], F.array().cast("array<int>"))
    return out.select(counted["doc_id"], "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
