"""Token ids as canonical length-limited Huffman codes.

1. Each text becomes ids with the ``tokenizers`` library, and the end id.  A
   text is cut where the tokenizer's own pre-tokenizer always cuts (before
   blanks, between letters and punctuation, at line breaks), so that equal
   pieces are encoded once and remembered.  Texts that hold an added token's
   string are encoded whole; ``literal`` takes special tokens' strings for
   ordinary text, the library's default doesn't.
2. Ids are counted over all documents as they are made; package-merge gives code lengths of
   LIMIT bits at most, and canonical codes follow from the lengths alone.
3. Documents are range-partitioned and sorted by doc_id.  Every partition
   writes independent blocks of whole documents: ids' codes, the bit offset of
   every STEP-th id (checkpoints), doc_ids and lengths.
4. Reading decodes a block by table, all its checkpoints side by side.

A file is a folder with ``blocks`` and ``codebook`` (Parquet), so that writing
it is atomic and survives lost executors like any Spark write.

Cases: a null or empty text is the end id alone; null doc_ids come first and
rows of equal doc_id are in order of their ids; extra columns are ignored; an
empty table gives an empty file.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm import textops as T
from docloom.llm.shared import new_path, record, written

LIMIT, STEP, BLOCK_IDS = 18, 128, 1 << 17
#: Pieces that a Python worker remembers at most (about 30 bytes each); it forgets them all and starts anew beyond that.
REMEMBERED = 1 << 21

#: Words that are encoded as one text, and texts at a time.
JOINED, TEXTS = 256, 64

_BLANK, _BREAK, _WIDE, _OTHER, _LETTER, _MARK = 1, 2, 3, 4, 5, 6
#: Kind of each byte: 0 control, then blank, line break, part of a wider character, and visible ASCII: digits and apostrophe, letters, punctuation.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(48, 58), 39]] = _OTHER
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[32], _KIND[10], _KIND[128:] = _BLANK, _BREAK, _WIDE


class Encoder:
    """Ids of whole texts, piece by piece."""

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if t.content and not (literal and t.special)]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # characters of each token: in a byte-level vocabulary, the bytes of text that it stands for
        vocab = self.tokenizer.get_vocab()
        self.chars = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.chars[list(vocab.values())] = [len(x) for x in vocab]
        self.forget()

    def forget(self) -> None:
        self.hash, self.first, self.size = np.zeros(0, T.U64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def pieces(self, c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the pieces.  A text is cut

        * before a blank that a visible ASCII character follows, or that stands between one and a non-ASCII character;
        * between an ASCII letter and ASCII punctuation other than an apostrophe;
        * between a visible ASCII character and a line break, and behind that one if another visible ASCII character follows.
        """
        buf, n = c.buf, len(c.buf)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            kind = _KIND[buf]
            visible = kind >= _OTHER
            prev, here, after = kind[:-2], kind[1:-1], kind[2:]
            mid = (here == _BLANK) & (visible[2:] | ((after == _WIDE) & visible[:-2]))
            mid |= (here == _MARK) & (prev == _LETTER)
            mid |= (here == _BREAK) & visible[:-2]
            cut[1 : n - 1] = mid
            # behind a single line break; the text number is the same where the break isn't a text's last or first byte
            lone = (here == _BREAK) & visible[:-2] & visible[2:]
            cut[2:n] |= lone
            # what a text's last byte is followed by and its first byte preceded by belongs to another text
            edge = c.offs[1:-1] - 1
            edge = edge[(edge >= 0) & (edge < n)]
            cut[edge[kind[edge] == _BLANK]] = False
        cut[c.offs[:-1]] = True
        start = np.flatnonzero(cut[:n])
        return start, np.append(start[1:], n)[: len(start)]

    def __call__(self, c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of each text of the chunk."""
        start, end = self.pieces(c)
        n = len(c.buf)
        power, _ = T.powers(n + 1)
        prefix = np.zeros(n + 1, T.U64)
        np.cumsum(T._BYTE[c.buf] * power[:n], out=prefix[1:])
        unique, first, place = _distinct(T.span_hash(prefix, start, end))
        at = np.searchsorted(self.hash, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == unique[inside]
        if not known.all():
            if len(self.hash) + len(unique) > REMEMBERED:
                self.forget()
                known[:] = False
            self._learn(c, unique[~known], start[first[~known]], end[first[~known]])
            at = np.searchsorted(self.hash, unique)
        lo, size = self.first[at][place].astype(np.int64), self.size[at][place]
        ends = np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(start, c.offs)]
        whole = self.whole(c)
        if not len(whole):
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        raw = c.buf.tobytes()
        for i in whole.tolist():
            parts[i] = np.array(self.tokenizer.encode(raw[c.offs[i] : c.offs[i + 1]].decode(), add_special_tokens=False).ids, self.dtype)
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    def whole(self, c: T.Chunk) -> np.ndarray:
        """Numbers of the texts that hold an added token's string."""
        raw, found = c.buf.tobytes() if self.added else b"", []
        for mark in self.added:
            at = raw.find(mark)
            while at >= 0:
                i = int(np.searchsorted(c.offs, at, "right")) - 1
                inside = at + len(mark) <= c.offs[i + 1]
                if inside:
                    found.append(i)
                at = raw.find(mark, int(c.offs[i + 1]) if inside else at + 1)
        return np.unique(np.array(found, np.int64))

    def _learn(self, c: T.Chunk, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remember the ids of pieces with the sorted hashes ``h``.

        Pieces from a blank and a visible ASCII character to one are encoded many in
        a row, as the pre-tokenizer cuts before such a blank and looks no further back;
        the tokens' lengths say which word an id is of.
        """
        raw, visible = c.buf.tobytes(), _KIND >= _OTHER
        plain = (c.buf[start] == 32) & visible[c.buf[np.minimum(start + 1, end - 1)]] & visible[c.buf[end - 1]]
        spans = lambda at: zip(start[at].tolist(), end[at].tolist(), strict=True)
        size, order, ids = np.zeros(len(h), np.int64), [], [self.ids]
        word = np.flatnonzero(plain)
        for i in range(0, len(word), JOINED * TEXTS):
            rows = [word[j : j + JOINED] for j in range(i, min(i + JOINED * TEXTS, len(word)), JOINED)]
            some = word[i : i + JOINED * TEXTS]
            long = end[some] - start[some]
            offs = np.append(0, np.cumsum(long))
            joined = c.buf[np.repeat(start[some] - offs[:-1], long) + np.arange(offs[-1])].tobytes()
            edges = [*offs[:-1:JOINED].tolist(), len(joined)]
            texts = [joined[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for at, x in zip(rows, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                new = np.array(x.ids, self.dtype)
                till, ends = np.cumsum(end[at] - start[at]), np.cumsum(self.chars[new])
                last = np.searchsorted(ends, till)
                if not len(new) or ends[-1] != till[-1] or (ends[last] != till).any():  # this tokenizer cuts elsewhere
                    plain[at] = False
                    continue
                size[at] = np.diff(last, prepend=-1)
                order.append(at)
                ids.append(new)
        other = np.flatnonzero(~plain)
        for i in range(0, len(other), 1 << 14):
            at = other[i : i + (1 << 14)]
            new = [x.ids for x in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in spans(at)], add_special_tokens=False)]
            size[at] = [len(x) for x in new]
            order.append(at)
            ids.append(np.fromiter(chain.from_iterable(new), self.dtype, int(size[at].sum())))
        by = np.concatenate([*order, np.zeros(0, np.int64)])
        first = np.zeros(len(h), np.int64)
        first[by] = len(self.ids) + np.cumsum(size[by]) - size[by]
        self.ids = np.concatenate(ids)
        at = np.searchsorted(self.hash, h) + np.arange(len(h))
        old = np.ones(len(self.hash) + len(h), bool)
        old[at] = False

        def merged(known: np.ndarray, new: np.ndarray) -> np.ndarray:
            out = np.empty(len(old), known.dtype)
            out[at], out[old] = new, known
            return out

        self.hash, self.first, self.size = merged(self.hash, h), merged(self.first, first), merged(self.size, size)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number of each place's value (any of equal places will do, which spares np.unique's stable sort)."""
    by = np.argsort(h)
    ordered = h[by]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(h)]
    place = np.empty(len(h), np.int64)
    place[by] = np.cumsum(new) - 1
    return ordered[new], by[new], place


_encoders: dict[tuple[str, bool], Encoder] = {}


def tokenised(docs: DataFrame, tokenizer: str, end_id: int | None, literal: bool = True) -> DataFrame:
    """doc_id and ids (little-endian, 2 or 4 bytes by the vocabulary's size) of each row.

    Each task adds a row of its own without them, whose ``counts`` are the occurrences of every id of the vocabulary.
    """
    kind = docs.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, literal) not in _encoders:
            _encoders[tokenizer, literal] = Encoder(tokenizer, literal)
        encoder = _encoders[tokenizer, literal]
        total = np.zeros(encoder.tokenizer.get_vocab_size(), np.int64)
        for b in batches:
            for c in T.chunks(b.column(1), 1 << 21):
                ids, bounds = encoder(c)
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], encoder.dtype(end_id))
                    bounds = bounds + np.arange(len(bounds))
                total += np.bincount(ids, minlength=len(total))
                data = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], data, pa.nulls(len(data), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, to_arrow_type(kind)), pa.nulls(1, pa.binary()), pa.array([total.tobytes()])], names)

    names = ["doc_id", "ids", "counts"]
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind.simpleString()}, ids binary, counts binary")


def _flat(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and the bounds of each row's."""
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return data.view(dtype), (offs - offs[0]) // np.dtype(dtype).itemsize


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each of ``size`` ids over all documents, from the tasks' own counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for counts in b.column(0):
                total += np.frombuffer(counts.as_buffer(), np.int64)
        key = np.flatnonzero(total)
        yield record("id:long n:long", id=key, n=total[key])

    found = tokens.select("counts").filter("counts is not null").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def _dtype(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of ``limit`` bits at most (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 1:
        out[used] = 1
    if n < 2:
        return out
    limit = max(limit, int(np.ceil(np.log2(n))))
    by = used[np.argsort(counts[used], kind="stable")]
    coins = counts[by].astype(np.float64)
    levels, row, is_coin = [], coins, np.ones(n, bool)
    for _ in range(limit):
        levels.append(is_coin)
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.append(coins, packages)
        order = np.argsort(both, kind="stable")
        row, is_coin = both[order], order < n
    length, take = np.zeros(n, np.int64), 2 * (n - 1)
    for is_coin in reversed(levels):
        taken = int(is_coin[:take].sum())
        length[:taken] += 1
        take = 2 * (take - taken)
    out[by] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    by = np.lexsort((np.arange(len(lengths)), lengths))
    by = by[lengths[by] > 0]
    top = int(lengths.max(initial=0))
    step = np.uint64(1) << (top - lengths[by].astype(np.int64)).astype(np.uint64)
    codes = np.zeros(len(lengths), np.uint64)
    codes[by] = (np.cumsum(step) - step) >> (top - lengths[by].astype(np.int64)).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids' codes, most significant first, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    here = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[first]] = np.bitwise_or.reduceat(here, first)
    over = room < 0
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.byteswap().tobytes()[: (int(ends[-1]) + 7) // 8], at[::STEP].astype(np.uint32)


class Decoder:
    """Table of all bit strings of the longest code's length: id and code length."""

    def __init__(self, lengths: np.ndarray):
        self.top = max(int(lengths.max(initial=0)), 1)
        self.id, self.size = np.zeros(1 << self.top, np.uint32), np.ones(1 << self.top, np.uint8)
        by = np.lexsort((np.arange(len(lengths)), lengths))
        by = by[lengths[by] > 0]
        span = 1 << (self.top - lengths[by].astype(np.int64))
        self.id[: span.sum()] = np.repeat(by, span)
        self.size[: span.sum()] = np.repeat(lengths[by], span)

    def __call__(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The block's ``n`` ids: STEP rounds of table look-ups, from all checkpoints at once."""
        b = np.append(np.frombuffer(payload, np.uint8), np.zeros(8 + STEP * self.top // 8, np.uint8)).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((len(at), STEP), np.uint32)
        for k in range(STEP):
            peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.top)
            out[:, k] = self.id[peek]
            at += self.size[peek]
        return out.ravel()[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, literal: bool = True) -> None:
    """Encode every text and write the file ``path`` in ascending order of doc_id."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    tokens = written(tokenised(docs, tokenizer, end_id, literal), "ids")
    lengths = code_lengths(id_counts(tokens, size))
    shared, dtype = spark.sparkContext.broadcast(lengths), _dtype(size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        codes = canonical(lengths)
        number, before = 0, 0

        def block(ids: np.ndarray, size: np.ndarray, docs: pa.Array) -> pa.RecordBatch:
            payload, checkpoints = pack(ids, lengths, codes) if len(ids) else (b"", np.zeros(0, np.uint32))
            list_of = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number]), pa.array([before]), pa.array([len(ids)]), list_of(docs), list_of(pa.array(size)), pa.array([checkpoints.tobytes()]), pa.array([payload])], ["shard", "block", "start", "n", "doc_ids", "sizes", "checkpoints", "payload"])

        for b in batches:
            ids, bounds = _flat(b.column(1), dtype)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK_IDS, "right")) - 1)
                some = ids[bounds[lo] : bounds[hi]]
                yield block(some, np.diff(bounds[lo : hi + 1]), b.column(0)[lo:hi])
                number, before, lo = number + 1, before + len(some), hi

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = tokens.filter("ids is not null").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(encode, f"shard int, block long, start long, n long, doc_ids array<{kind}>, sizes array<long>, checkpoints binary, payload binary").write.parquet(f"{path}/blocks")
    spark.createDataFrame(pa.table({"id": pa.array(np.arange(size)), "bits": pa.array(lengths.astype(np.int32))})).write.parquet(f"{path}/codebook")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids before the document's) and ids (array of long), or with ``digest`` n_tokens and ids_crc32 in place of ids."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()  # one row for each id of the vocabulary
    lengths = np.zeros(book.num_rows, np.uint8)
    lengths[book["id"].to_numpy()] = book["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n"))  # a row for each task that wrote
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = blocks.join(before, "shard").select("doc_ids", "sizes", "checkpoints", "payload", (F.col("start") + F.col("before")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                size = b.column(1)[i].values.to_numpy()
                ends = np.append(0, np.cumsum(size))
                ids = decoder(b.column(3)[i].as_buffer(), np.frombuffer(b.column(2)[i].as_buffer(), np.uint32), int(ends[-1]))
                docs, start = b.column(0)[i].values, b.column(4)[i].as_py() + ends[:-1]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.RecordBatch.from_arrays([docs, pa.array(start), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64)))], ["doc_id", "start", "ids"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return placed.mapInArrow(decode, f"doc_id {kind}, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<long>"))


def op10_huffman_ids(docs: DataFrame, tokenizer: str, literal: bool = True) -> DataFrame:
    """Write every document's ids with end id 2, and return what reading the file back gives for each."""
    path = new_path(docs.sparkSession, "huffman")
    write_ids(docs.select("doc_id", "text"), path, tokenizer, literal=literal)
    return read_ids(docs.sparkSession, path, digest=True)
