"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

Symbols are the code points of the texts, all of them, and n-grams have four.
Spark counts the n-grams of every whole text (each task adds up its own, then a
grouped sum) and smooths the counts order by order with grouped sums and joins,
so the model is a table that grows with the corpus and that no process holds.

A model of at most MOST n-grams goes to every task as arrays sorted by hash (64
MiB).  Beyond that texts are put into blocks of about BLOCK bytes, each block's
distinct n-grams are joined with the model, and the block meets its own part of
it, as such arrays; scores are the same.  A document is scored by its mean
log-probability; documents outside their language's band are rejected.  Bands
are those of the documents that pass the base rules.

A text must not vouch for itself: beside this its held-out score takes each
n-gram that one text only has (with its exact copies) as one that the model has
not seen, by the back-off, and must not lie above its language's band.

Cases: a null or empty text has no words, fails the base rule and has a null
perplexity; a null ``lang`` is a language of its own; repeated rows and ids are
scored row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docloom.llm import textops as T
from docloom.llm.shared import dropped, record, written

#: Symbols: 0 stands before a text's start, the others are the code points.
V, ORDER, BITS = 0x110001, 4, 21
#: Symbol of each code point.
CLASS = np.arange(1, V, dtype=np.int32)
#: An n-gram: its symbols but the last, BITS each, and the last.
KEY = np.dtype([("context", np.int64), ("symbol", np.int32)])
#: Bytes of a block of texts, about, and distinct n-grams that a task adds up before it passes them on.
BLOCK, PENDING = 32 << 20, 1 << 22
#: N-grams of a model that is sent whole to every task, at most (16 bytes each).
MOST = 1 << 22
#: Languages whose bands are sent to every task, at most; more are joined.
MOST_BANDS = 1 << 16
#: Bands reach this many interquartile ranges beyond the quartiles of a language's log-perplexity.
BAND_WIDTH = 2.0
#: Half-width of a band at least, in log-perplexity.
BAND_LEAST = 0.03
#: A text's log-perplexity is drawn to its language's median with the weight of so many characters: short texts are noisy.
PRIOR_CHARS = 200


def code_points(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk, and the bounds of each text's."""
    lead = np.flatnonzero((c.buf & 0xC0) != 0x80)
    point = c.buf[lead].astype(np.int32)
    wide = np.flatnonzero(point >= 0xC0)
    if len(wide):
        b0, at = point[wide], lead[wide]
        b1, b2, b3 = (np.append(c.buf, np.zeros(3, np.uint8))[at + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        two, three = (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2
        four = (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
        point[wide] = np.minimum(np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four)), V - 2)
    return point, np.searchsorted(lead, c.offs)


def ngrams(c: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol) of the n-gram that ends at each code point, and texts' bounds; symbols before a text's start are 0."""
    points, offs = code_points(c)
    cur = CLASS[points]
    starts = offs[:-1][offs[:-1] < len(cur)]
    context, back = np.zeros(len(cur), np.int64), cur
    for k in range(ORDER - 1):
        prev = np.zeros_like(back)
        prev[1:] = back[:-1]
        prev[starts] = 0
        context |= prev.astype(np.int64) << BITS * k
        back = prev
    return context, cur, offs


def ngram_keys(c: T.Chunk) -> np.ndarray:
    """The same as an array of KEY."""
    context, symbol, _ = ngrams(c)
    return _keys(context, symbol)


def _keys(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    out = np.empty(len(symbol), KEY)
    out["context"], out["symbol"] = context, symbol
    return out


def _hash(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """64-bit hash of n-grams."""
    return T.mix(T.mix(np.asarray(context).astype(T.U64)) + np.asarray(symbol).astype(T.U64) * T.U64(T._ODD)).view(np.int64)


def _text_hash(c: T.Chunk) -> np.ndarray:
    """Hash of each text, not 0."""
    power, _ = T.powers(len(c.buf) + 1)
    prefix = np.zeros(len(c.buf) + 1, T.U64)
    np.cumsum(T._BYTE[c.buf] * power[: len(c.buf)], out=prefix[1:])
    return (T.span_hash(prefix, c.offs[:-1], c.offs[1:]) | T.U64(1)).view(np.int64)


def _added(parts: list[tuple]) -> tuple:
    """(hash, context, symbol, n, owner) of distinct n-grams, sorted by hash; the owner is the only text's hash, or 0."""
    h, context, symbol, n, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
    least, most = np.minimum.reduceat(owner[by], first), np.maximum.reduceat(owner[by], first)
    return h[by[first]], context[by[first]], symbol[by[first]], np.add.reduceat(n[by], first), np.where(least == most, least, 0)


def _dense(c: T.Chunk) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """N-gram that ends at each code point as a number of ORDER * bits bits, bits, the symbol of each number below 2**bits, and texts' bounds.

    Symbols are numbered within the chunk, so that n-grams of any alphabet are short and sort fast.
    """
    points, offs = code_points(c)
    used = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, np.int64)
    bits = max(len(used).bit_length(), 1)
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, T.U64)
    number[used] = np.arange(1, len(used) + 1)
    cur = number[points]
    starts = offs[:-1][offs[:-1] < len(cur)]
    key, back = cur.copy(), cur
    for k in range(1, ORDER):
        prev = np.zeros_like(back)
        prev[1:] = back[:-1]
        prev[starts] = 0
        key |= prev << T.U64(bits * k)
        back = prev
    symbols = np.zeros(1 << bits, np.int64)
    symbols[1 : len(used) + 1] = CLASS[used]
    return key, bits, symbols, offs


def _spelled(key: np.ndarray, bits: int, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of n-grams numbered within a chunk."""
    at = [symbols[((key >> T.U64(bits * k)) & T.U64((1 << bits) - 1)).astype(np.int64)] for k in range(ORDER)]
    return sum((at[k] << BITS * (k - 1) for k in range(2, ORDER)), at[1]), at[0].astype(np.int32)


def _sorted_with(key: np.ndarray, width: int, other: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``key`` (of ``width`` bits) and ``other`` (below ``most``), sorted by both."""
    more = max((most - 1).bit_length(), 1)
    if width + more > 64:
        by = np.lexsort((other, key))
        return key[by], other[by]
    both = np.sort(key << T.U64(more) | other.astype(T.U64))
    return both >> T.U64(more), (both & T.U64((1 << more) - 1)).astype(np.int64)


def _counted(c: T.Chunk) -> tuple | None:
    """The chunk's distinct n-grams as :func:`_added` gives them."""
    key, bits, symbols, offs = _dense(c)
    if not len(key):
        return None
    key, doc = _sorted_with(key, ORDER * bits, np.repeat(np.arange(len(offs) - 1), np.diff(offs)), len(offs) - 1)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    last = np.append(first[1:], len(key)) - 1
    text = _text_hash(c)
    owner = np.where(text[doc[first]] == text[doc[last]], text[doc[first]], 0)
    for i in np.flatnonzero((owner != 0) & (doc[first] != doc[last])).tolist():  # a copy at either end: what lies between
        owner[i] = owner[i] if (text[doc[first[i] : last[i] + 1]] == owner[i]).all() else 0
    context, symbol = _spelled(key[first], bits, symbols)
    return _added([(_hash(context, symbol), context, symbol, last - first + 1, owner)])


def _distinct(chunks: Iterator[T.Chunk]) -> Iterator[tuple]:
    """Tables of distinct n-grams; an n-gram is in several if there are more than PENDING."""
    parts, size = [], 0
    for c in chunks:
        found = _counted(c)
        if found is None:
            continue
        parts.append(found)
        size += len(found[0])
        if size > PENDING:
            parts = [_added(parts)]
            size = len(parts[0][0])
            if size > PENDING // 2:
                yield parts[0]
                parts, size = [], 0
    if parts:
        yield _added(parts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, context, symbol, n, owner in _distinct(c for b in batches for c in T.chunks(b.column(0))):
        for i in range(0, len(n), 1 << 16):
            at = slice(i, i + (1 << 16))
            yield record("context:long symbol:int n:long owner:long", context=context[at], symbol=symbol[at], n=n[at], owner=owner[at])


def _shorter(key: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of n-grams."""
    return _keys(key["context"] & ((1 << BITS * (order - 1)) - 1), key["symbol"])


def _cuts(have: list[int]) -> list[float]:
    """Discounts of counts 0, 1, 2 and more, from how many n-grams have the counts 1 to 4."""
    have = [max(int(x), 1) for x in have]
    y = have[0] / (have[0] + 2 * have[1])
    return [0.0] + [min(max(i - (i + 1) * y * have[i] / have[i - 1], 0.05), 0.95 * i) for i in (1, 2, 3)]


@dataclass
class Model:
    """A model in one process: for each order sorted n-gram hashes with log-probabilities, and sorted context hashes with log back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    backs: list[tuple[np.ndarray, np.ndarray]]

    def lookup(self, key: np.ndarray) -> np.ndarray:
        """log P(last symbol | the symbols before it): longest n-gram found, after the back-off weights of longer contexts."""
        out, left = np.zeros(len(key)), np.arange(len(key))
        for order in range(ORDER, 0, -1):
            hashes, logp = self.grams[order]
            short = _shorter(key[left], order)
            at, hit = _find(hashes, _hash(short["context"], short["symbol"]))
            out[left[hit]] += logp[at[hit]]
            left, short = left[~hit], short[~hit]
            if len(left):
                hashes, weight = self.backs[order]
                at, hit = _find(hashes, _hash(short["context"], np.zeros(len(short), np.int32)))
                out[left[hit]] += weight[at[hit]]
        out[left] -= np.log(V)
        return out


def _find(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(hashes, wanted), max(len(hashes) - 1, 0))
    return at, hashes[at] == wanted if len(hashes) else np.zeros(len(wanted), bool)


def estimate(key: np.ndarray, n: np.ndarray) -> Model:
    """:func:`smoothed` for counts that fit one process: what its table is held against."""
    counts = [(key, n)] * (ORDER + 1)
    for order in range(ORDER - 1, 0, -1):
        above, m = counts[order + 1]
        low, place = np.unique(_shorter(above, order), return_inverse=True)
        start = low["context"] >> BITS * (order - 2) == 0 if order > 1 else np.zeros(len(low), bool)
        counts[order] = low, np.where(start, np.bincount(place, m), np.bincount(place)).astype(np.int64)
    p, below = np.full(1, 1.0 / V), None
    grams, backs = [(np.zeros(0), np.zeros(0))] * (ORDER + 1), [(np.zeros(0), np.zeros(0))] * (ORDER + 1)
    for order in range(1, ORDER + 1):
        low, c = counts[order]
        discount = np.array(_cuts([(c == i).sum() for i in range(1, 5)]))[np.minimum(c, 3)]
        context, place = np.unique(low["context"], return_inverse=True)
        total = np.bincount(place, c)
        weight = np.bincount(place, discount) / total
        base = p[0] if below is None else p[np.searchsorted(below, _shorter(low, order - 1))]
        p, below = (c - discount) / total[place] + weight[place] * base, low
        grams[order] = _sorted(_hash(low["context"], low["symbol"]), np.log(p))
        backs[order] = _sorted(_hash(context, np.zeros(len(context), np.int32)), np.log(np.maximum(weight, 1e-12)))
    return Model(grams, backs)


def _sorted(h: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(h)
    return h[by], value[by].astype(np.float32)


def smoothed(docs: DataFrame) -> DataFrame:
    """``context``, ``symbol``, ``p`` and ``held`` of every n-gram of ``docs``: modified Kneser-Ney (three discounts for each order, interpolated).

    ``held`` is ``p``, but for an n-gram with an owner that of an n-gram not seen: the back-off weight (1 if its context has the same owner) times the shorter one's ``held``.
    """
    one = F.when(F.min("owner") == F.max("owner"), F.min("owner")).otherwise(0).alias("owner")
    found = docs.select("text").mapInArrow(_count, "context long, symbol int, n long, owner long").groupBy("context", "symbol").agg(F.sum("n").alias("n"), one)
    counts = {ORDER: written(found, "ngrams")}
    for order in range(ORDER - 1, 0, -1):
        low = counts[order + 1].withColumn("context", F.col("context").bitwiseAND((1 << BITS * (order - 1)) - 1))
        starts = F.shiftright("context", BITS * (order - 2)) == 0 if order > 1 else F.lit(False)  # n-grams from a text's start keep their own counts
        counts[order] = written(low.groupBy("context", "symbol").agg(F.sum("n").alias("all"), F.count("n").alias("kinds"), one).select("context", "symbol", F.when(starts, F.col("all")).otherwise(F.col("kinds")).alias("n"), "owner"), f"ngrams{order}")
    below = None
    for order in range(1, ORDER + 1):
        c = counts[order]
        have = c.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()
        cut = _cuts(list(have))
        discount = F.when(F.col("n") == 1, cut[1]).when(F.col("n") == 2, cut[2]).otherwise(cut[3])
        of = c.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("lost"), one.alias("only"))
        got = c.join(of, "context").withColumn("own", (F.col("n") - discount) / F.col("total")).withColumn("weight", F.col("lost") / F.col("total"))
        if below is None:
            got = got.withColumn("base", F.lit(1.0 / V)).withColumn("base_held", F.lit(1.0 / V))
        else:
            short = below.select(F.col("context").alias("low"), "symbol", F.col("p").alias("base"), F.col("held").alias("base_held"))
            got = got.withColumn("low", F.col("context").bitwiseAND((1 << BITS * max(order - 2, 0)) - 1)).join(short, ["low", "symbol"])
        unseen = F.when(F.col("only") != 0, 1.0).otherwise(F.col("weight"))
        held = F.when(F.col("owner") != 0, unseen * F.col("base_held")).otherwise(F.col("own") + F.col("weight") * F.col("base_held"))
        p = got.select("context", "symbol", (F.col("own") + F.col("weight") * F.col("base")).alias("p"), held.alias("held"))
        p, used = written(p, f"model{order}"), [counts[order]] if below is None else [counts[order], below]
        dropped(*used)
        below = p
    return below


def base_statistics(c: T.Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(c.offs) - 1
    w = T.words(c)
    bounds = T.bounds_of(w.doc, n)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    out = {"n_words": np.diff(bounds), "word_chars": T.sums((~w.space & ((c.buf & 0xC0) != 0x80)).astype(np.int8), c.offs), "n_symbols": T.sums(symbol[c.buf].astype(np.int8), c.offs)}
    cover = np.zeros(len(w.doc) + 1, np.int32)
    doc, window = T.shingles(w, 5)
    if len(window):
        at = np.flatnonzero(w.doc[:-4] == w.doc[4:])
        window = T.mix(window + doc.astype(T.U64) * T.U64(T._ODD))
        ordered = np.sort(window)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
            at = at[twice[place] == window]
            cover[at] += 1
            cover[at + 5] -= 1
    out["n_repeat_words"] = T.sums((np.cumsum(cover)[:-1] > 0).astype(np.int8), bounds)
    out["n_dup_lines"] = _dup_lines(c, w, n)
    return out


def _dup_lines(c: T.Chunk, w: T.Words, n: int) -> np.ndarray:
    doc, start, end = T.lines(c)
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    doc, start, end = doc[worded], start[worded], end[worded]
    key = T.mix(T.span_hash(w.prefix, start, end) + doc.astype(T.U64) * T.U64(T._ODD))
    by = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[by[1:]] = key[by[1:]] == key[by[:-1]]
    return np.bincount(doc[again], minlength=n)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _slim(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``text``, ``lang`` and ``rest`` (struct of ``columns``) of every row."""
    rest = F.struct(F.lit(None).cast("int").alias("_"), *[docs[f"`{c}`"].alias(c) for c in columns])
    return docs.select(docs["text"].alias("text"), docs["lang"].cast("string").alias("lang"), rest.alias("rest"))


def _blocks(slim: DataFrame) -> DataFrame:
    """The rows with their ``block``, kept so that blocks are the same each time."""
    slim = slim.withColumn("block", F.spark_partition_id().cast("long"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for b in batches:
            text = b.column(0).cast(pa.large_string())
            if not len(text):
                continue
            long = np.diff(np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8))
            number = (size + np.cumsum(long) - long) // BLOCK
            size += int(long.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(b.column(3).to_numpy() << 32 | number)], ["text", "lang", "rest", "block"])

    return written(slim.mapInArrow(numbered, slim.schema), "blocks")


def _scores(column: pa.Array, h: np.ndarray, logp: np.ndarray) -> Iterator[tuple[T.Chunk, list[pa.Array]]]:
    """Chunks of texts with base statistics, log_ppl and log_held; ``logp`` of the sorted n-gram hashes ``h`` (every n-gram of the texts is there)."""
    for c in T.chunks(column):
        key, bits, symbols, offs = _dense(c)
        size, found = np.diff(offs), np.zeros((2, len(key)))
        if len(key):
            key, place = _sorted_with(key, ORDER * bits, np.arange(len(key)), len(key))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            value = logp[np.searchsorted(h, _hash(*_spelled(key[first], bits, symbols)))].astype(np.float64)
            for k in (0, 1):
                found[k, place] = np.repeat(value[:, k], np.diff(np.append(first, len(key))))
        with np.errstate(invalid="ignore", divide="ignore"):
            means = [pa.array(np.where(size > 0, -T.sums(x, offs) / size, np.nan), from_pandas=True) for x in found]
        stats = base_statistics(c)
        yield c, [*(pa.array(stats[k], pa.int64()) for k in NAMES), *means]


def _scored(docs: DataFrame, columns: list[str], carried: bool) -> DataFrame:
    """The rows of ``docs`` (lang, struct ``rest`` of ``columns``, and text if ``carried``) with base statistics, ``log_ppl`` and ``log_held``."""
    slim = _slim(docs, columns)
    model = smoothed(docs)
    have = ["text"] * carried + ["lang", "rest"]
    names = [*have, *NAMES, "log_ppl", "log_held"]
    schema = StructType([*(slim.schema[k] for k in have), *(StructField(k, LongType()) for k in NAMES), StructField("log_ppl", DoubleType()), StructField("log_held", DoubleType())])
    logs = model.select("context", "symbol", F.log("p").cast("float").alias("p"), F.log("held").cast("float").alias("held"))
    if model.count() <= MOST:
        found = logs.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(_arrays(found))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c, out in _scores(b.column(0), *shared.value):
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(c.lo, c.hi - c.lo) for k in have), *out], names)

        out = written(slim.mapInArrow(score, schema), "scored")
        shared.destroy()
        dropped(model)
        return out
    blocks = _blocks(slim)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct n-grams of each block (a task's neighbouring rows)."""

        def given(block: int, chunks: Iterator[T.Chunk]) -> Iterator[pa.RecordBatch]:
            for _, context, symbol, _, _ in _distinct(chunks):
                for i in range(0, len(symbol), 1 << 16):
                    at = slice(i, i + (1 << 16))
                    yield record("block:long context:long symbol:int", block=np.full(len(symbol[at]), block), context=context[at], symbol=symbol[at])

        def runs() -> Iterator[tuple[int, T.Chunk]]:
            for b in batches:
                block = b.column(0).to_numpy()
                edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
                for i, j in zip(edges, [*edges[1:], len(block)], strict=True):
                    yield from ((int(block[i]), c) for c in T.chunks(b.column(1).slice(i, j - i)))

        for block, run in groupby(runs(), lambda x: x[0]):
            yield from given(block, (c for _, c in run))

    needs = blocks.select("block", "text").mapInArrow(wanted, "block long, context long, symbol int")
    parts = needs.join(logs, ["context", "symbol"]).select("block", "context", "symbol", "p", "held")

    def meet(texts: pa.Table, part: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        out = []
        for c, got in _scores(texts["text"], *_arrays(part)):
            rows = texts.slice(c.lo, c.hi - c.lo)
            out.append(pa.table([*(rows[k] for k in have), *got], names))
        return pa.concat_tables(out)

    schema = StructType([*(blocks.schema[k] for k in have), *schema.fields[len(have) :]])
    out = written(blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(meet, schema), "scored")
    dropped(model, blocks)
    return out


def _arrays(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams, and their two log-probabilities."""
    return _sorted(_hash(found["context"].to_numpy(), found["symbol"].to_numpy()), np.stack([found["p"].to_numpy(), found["held"].to_numpy()], 1))


def bands(found: DataFrame, width: float = BAND_WIDTH, least: float = BAND_LEAST) -> DataFrame:
    """``band_lang``, and for log_ppl and log_held ``middle``, ``lower`` and ``upper``, from the quartiles of each language's documents."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.round(c, 3).alias("v")) for c in ("log_ppl", "log_held")])).alias("x")
    # exact quartiles of values in thousandths, whatever the order in which tasks end
    counted = found.filter(F.col("log_ppl").isNotNull()).select("lang", values).groupBy("lang", "x.c", "x.v").count()
    found = counted.groupBy("lang", "c").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("count")).alias("q"))
    found = found.groupBy("lang").agg(*[F.any_value(F.when(F.col("c") == c, F.col("q")), True).alias(f"q_{c}") for c in ("log_ppl", "log_held")])
    out = [F.col("lang").alias("band_lang")]
    for c in ("log_ppl", "log_held"):
        low, middle, high = (F.col(f"q_{c}")[k] for k in range(3))
        reach = F.greatest(F.lit(width) * (high - low), F.lit(least))
        out += [middle.alias(f"middle_{c}"), (low - reach).alias(f"lower_{c}"), (high + reach).alias(f"upper_{c}")]
    return found.select(*out)


def judged(docs: DataFrame, columns: list[str], carried: bool, width: float = BAND_WIDTH, least: float = BAND_LEAST) -> DataFrame:
    """Every row of ``docs`` (struct ``rest`` of ``columns``, and ``text`` if ``carried``) with base statistics, log_ppl, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = _scored(docs, columns, carried).withColumn("base_failed", failed)
    limits = written(bands(found.filter("not base_failed"), width, least), "bands")
    limits = F.broadcast(limits) if limits.count() <= MOST_BANDS else limits
    drawn = lambda c: F.col(f"middle_{c}") + (F.col(c) - F.col(f"middle_{c}")) * F.col("word_chars") / (F.col("word_chars") + PRIOR_CHARS)
    inside = drawn("log_ppl").between(F.col("lower_log_ppl"), F.col("upper_log_ppl")) & (drawn("log_held") <= F.col("upper_log_held"))
    return found.join(limits, found["lang"].eqNullSafe(limits["band_lang"]), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op1_perplexity(docs: DataFrame) -> DataFrame:
    """Statistics, base rule and verdict of every document."""
    out = judged(docs, ["doc_id"], False)
    return out.select(F.col("rest.doc_id").alias("doc_id"), *NAMES, "base_failed", "kept", "log_ppl")


def quality_stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged."""
    out = judged(docs, [c for c in docs.columns if c != "text"], True).filter("kept")
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
