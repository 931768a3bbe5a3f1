"""Language identification by cross-parsing entropy.

Each language has a reference made of labelled text and its suffix automaton.
A text is cross-parsed: from where the last phrase ended, the longest match
anywhere in the reference is the next phrase.  The fewer phrases for its
length, the nearer the text is; phrases are normalised by log2 of the reference's
length.  The language of the lowest rate wins, the first by name in a tie.

The automata's transitions form one hash table of (state, character), over all
characters that occur in the references, and all texts of a chunk are parsed side
by side, in segments of SEGMENT characters of which every one is parsed.

Cases: null texts and texts without a letter are ``und`` with score 0, as is
everything if nothing could be learnt; rows with null text or lang teach
nothing; repeated rows are predicted row by row and teach once; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import textops as T

#: Labelled rows of a language that teach at most, each with its whole text.
SAMPLE = 64
SEGMENT = 256


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fold(text: str) -> str:
    """Lower case, each run of white space one blank."""
    return " ".join(text.lower().split())


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``, by state; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


#: Bits of a character's number in a transition's key.
BITS = 21
#: Code points, or transitions, that are worked on at a time where the tables are built.
BLOCK = 1 << 16


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.astype(T.U64) * T.U64(T._ODD) >> T.U64(64 - bits)).astype(np.int64)


def transitions(key: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash table with linear probing: keys (-1 is free) and values."""
    bits = max(int(2 * len(key)).bit_length(), 1)
    keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
    for lo in range(0, len(key), BLOCK):  # the working arrays are those of a block
        some, goal = key[lo : lo + BLOCK], to[lo : lo + BLOCK]
        at = _slot(some, bits)
        left = np.arange(len(some))
        while len(left):
            free = keys[at[left]] < 0
            slots, which = np.unique(at[left[free]], return_index=True)
            put = left[free][which]
            keys[slots], values[slots] = some[put], goal[put]
            left = left[keys[at[left]] != some[left]]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
    return keys, values


@dataclass
class Parser:
    """All languages' automata in one table; ``code`` numbers code points: 0 those in no reference, the last number is padding."""

    names: list[str]
    code: np.ndarray
    letter: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    roots: np.ndarray
    first: np.ndarray
    norm: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the symbols lead, -1 for nowhere."""
        key = (state << BITS | symbol).ravel()
        bits = len(self.keys).bit_length() - 1
        slot = _slot(key, bits)
        found = self.keys.take(slot)
        out = np.where(found == key, self.values.take(slot), -1).astype(np.int64)
        left = np.flatnonzero((found != key) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << bits) - 1)
            found, wanted = self.keys.take(slot), key[left]
            hit = found == wanted
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (found >= 0)
            left, slot = left[more], slot[more]
        return out.reshape(state.shape)

    def phrases(self, c: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by text and language, characters, has a letter) of each text."""
        points = np.frombuffer(c.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        offs = np.append(0, np.cumsum((c.buf & 0xC0) != 0x80))[c.offs]
        points = np.minimum(points, len(self.code) - 1)
        size = np.diff(offs)
        letters = T.sums(self.letter[points].astype(np.int8), offs) > 0
        rows = -(-size // SEGMENT)
        begin = np.append(0, np.cumsum(rows))
        doc = np.repeat(np.arange(len(size)), rows)
        pad = self.first.shape[1] - 1
        grid = np.full((SEGMENT, int(begin[-1])), pad, np.int32)
        place = np.arange(len(points)) - np.repeat(offs[:-1], size)
        grid[place % SEGMENT, begin[np.repeat(np.arange(len(size)), size)] + place // SEGMENT] = self.code[points]
        root = np.repeat(self.roots[:, None], grid.shape[1], 1)
        state, count = root.copy(), np.zeros(root.shape, np.int32)
        # lanes by falling length, so that those that have ended are left out
        long = np.full(len(doc), SEGMENT)
        long[begin[1:][rows > 0] - 1] = (size - (rows - 1) * SEGMENT)[rows > 0]
        by = np.argsort(-long, kind="stable")
        grid, alive = grid[:, by], np.searchsorted(-long[by], -np.arange(SEGMENT), "left")
        for k in range(SEGMENT):
            n = int(alive[k])
            if not n:
                break
            symbol = grid[k, :n].astype(np.int64)
            here, base = state[:, :n], root[:, :n]
            to = self.step(here, np.broadcast_to(symbol, here.shape))
            stop = to < 0
            if stop.any():
                again = self.first[:, symbol]
                count[:, :n] += stop & (here != base)
                count[:, :n] += stop & (again < 0)  # a character that the reference doesn't have is a phrase of its own
                to = np.where(stop, np.where(again < 0, base, again), to)
            state[:, :n] = to
        count += state != root
        out = np.zeros((len(size), len(self.names)), np.int64)
        np.add.at(out, doc[by], count.T)
        return out, size, letters

    def predict(self, c: T.Chunk) -> tuple[list[str], np.ndarray]:
        count, size, letters = self.phrases(c)
        if not self.names:
            return ["und"] * len(size), np.zeros(len(size))
        rate = count * self.norm / np.maximum(size, 1)[:, None]
        best = rate.argmin(1)
        low = rate.min(1)
        second = np.sort(rate, 1)[:, 1] if len(self.names) > 1 else low * 2
        score = np.where(letters & (second > 0), 1 - low / np.maximum(second, 1e-12), 0.0)
        return [self.names[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.clip(score, 0, 1)


def build(references: dict[str, str]) -> Parser:
    """The parser of folded reference texts by language."""
    names = sorted(references)
    texts = [references[n] for n in names]
    at = {x: i for i, x in enumerate(sorted(set().union(*texts)), 1)}
    code, letter = np.zeros(0x10FFFF + 2, np.int32), np.zeros(0x10FFFF + 2, bool)
    for lo in range(0, 0x10FFFF + 1, BLOCK):  # a million characters are never held as strings
        every = [chr(i) for i in range(lo, lo + BLOCK)]
        code[lo : lo + BLOCK] = [at.get(" " if x.isspace() else y if len(y := x.lower()) == 1 else x, 0) for x in every]
        letter[lo : lo + BLOCK] = [x.isalpha() for x in every]
    key, to, roots, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [], 0
    first = np.full((len(texts), len(at) + 2), -1, np.int64)
    for i, t in enumerate(texts):
        nxt = automaton([at[ch] for ch in t])
        size = np.fromiter(map(len, nxt), np.int64, len(nxt))
        edges = int(size.sum())
        symbol = np.fromiter((x for d in nxt for x in d), np.int64, edges)
        goal = np.fromiter((x for d in nxt for x in d.values()), np.int64, edges) + total
        first[i, symbol[: size[0]]] = goal[: size[0]]
        key.append(np.repeat(np.arange(len(nxt)) + total, size) << BITS | symbol)
        to.append(goal.astype(np.int32))
        roots.append(total)
        total += len(nxt)
        del nxt  # before the next language's is built
    keys, values = transitions(np.concatenate(key), np.concatenate(to))
    return Parser(names, code, letter, keys, values, np.array(roots, np.int64), first, np.log2([max(len(t), 2) for t in texts]) if texts else np.zeros(0))


def references(docs: DataFrame, sample: int = SAMPLE) -> dict[str, str]:
    """Folded whole texts of at most ``sample`` rows of each language, those of smallest hash, from the rows that aren't held out."""
    usable = docs.filter("text is not null and lang is not null").filter(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("k"), "text")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's rows of smallest hash, by language."""
        kept: dict[str, list] = {}
        for b in batches:
            langs, keys, texts = b.column(0), b.column(1).to_numpy(), b.column(2)
            for i in np.argsort(keys, kind="stable").tolist():
                heap = kept.setdefault(langs[i].as_py(), [])
                k = int(keys[i])
                if len(heap) < sample or -heap[0][0] > k:
                    heapq.heappush(heap, (-k, texts[i].as_py()))
                    if len(heap) > sample:
                        heapq.heappop(heap)
        for lang, heap in kept.items():
            for k, t in heap:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([-k], pa.int64()), pa.array([fold(t)])], ["lang", "k", "text"])

    found = usable.mapInArrow(least, "lang string, k long, text string").dropDuplicates(["lang", "k", "text"])
    by = Window.partitionBy("lang").orderBy("k", "text")
    out: dict[str, list[str]] = {}
    for r in found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= sample).orderBy("lang", "r").collect():  # ``sample`` texts for each language
        out.setdefault(r.lang, []).append(r.text)
    return {k: " ".join(v) for k, v in out.items() if "".join(v).strip()}


def predicted(docs: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in T.chunks(b.column(1)):
                lang, score = shared.value.predict(c)
                yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(parse, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op6_cross_parsing(docs: DataFrame) -> DataFrame:
    """Predicted language of every document."""
    docs = docs.select("doc_id", "text", "lang")
    out = predicted(docs, build(references(docs)))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
