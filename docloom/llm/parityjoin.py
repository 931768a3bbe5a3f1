"""Near duplicates: exact Jaccard join of word shingles by parity sketches.

A set is sketched by XOR: each shingle flips one position of a parity sketch, so
the Hamming distance of two sketches is at most the sets' symmetric difference.
Sizes fall into bands that double; a pair is looked for in the band of its
smaller set.  A band's sketch has P pieces of 2**64 positions each (a piece is
kept as the XOR of its shingles' hashes).  A pair of which one set has size n
differs in at most D(n) shingles and so in at most D(n) pieces: by the
pigeonhole principle at least P - D(n) pieces are equal.  P is so much above
D(n) that equal pieces that aren't empty are among them; of those a set passes
on only the D(n) + 1 of the most shingles (prefix filter over one order of all
pieces), and empty ones only where it has fewer than that.  Documents that share a piece are candidates; those whose
fixed parity sketches of 256 bits aren't too far apart are verified on the full
shingle sets of 64-bit hashes.

Equal sets (128-bit hash) are one node.  In a few rounds every node is held
against one centre of its buckets: first the node that shares most pieces with
all others, as the original of many copies does, then others.  At last all
pairs of a bucket that aren't connected yet are compared.  No link between
components is lost, and a large group of near copies costs a comparison each,
not all its pairs.

Cases: null and empty texts have no shingles and link with nothing; a text of
fewer than k words is one shingle; a null doc_id takes part, but never names a
component unless its whole group has null ids; rows with equal doc_id stand
alone each; extra columns are ignored or passed on; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import textops as T
from docloom.llm.components import components
from docloom.llm.shared import dropped, written

#: Bits of the filters that spare rows a shuffle; what passes them is joined exactly, so that their size decides work only.
WANT_BITS = 24
#: Star rounds at most before the pairs that are left are compared.
ROUNDS = 4
SKETCH = ("s0", "s1", "s2", "s3")


def _sets(c: T.Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the distinct k-word shingles of each text, sorted by hash; the whole sequence if it is shorter."""
    n = len(c.offs) - 1
    w = T.words(c, True)
    doc, h = T.shingles(w, k)
    size = np.diff(T.bounds_of(w.doc, n))
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        first = np.searchsorted(w.doc, short)
        whole = np.zeros(len(short), T.U64)
        for i in range(k - 1):
            on = size[short] > i
            whole[on] = whole[on] * T.U64(T._ODD) + w.hash[first[on] + i] + T.U64(1)
        doc, h = np.append(doc, short), np.append(h, T.mix(whole))
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return T.bounds_of(doc[new], n), h[new]


class Scheme:
    """Size bands for a threshold, and the sketch pieces that a set passes on."""

    def __init__(self, threshold: Fraction):
        self.num, self.den = threshold.numerator, threshold.denominator
        self.edges = np.int64(1) << np.arange(40, dtype=np.int64)
        self.pieces = self.apart(2 * self.edges - 1, (2 * self.edges - 1) * self.den // self.num) * 5 // 4 + 4

    def apart(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of sets of sizes n and m that reach the threshold."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)

    def signatures(self, bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the set, hash of band, piece and value) of all pieces that sets pass on, in their own band and the one below."""
        size = np.diff(bounds)
        sets = np.flatnonzero(size)
        n = size[sets]
        band = np.searchsorted(self.edges, n, "right") - 1
        below = self.edges[band] - 1  # the largest size of the band below
        low = (below > 0) & (below * self.den >= n * self.num)
        own = self._passed(bounds, h, sets, band, self.apart(n, n * self.den // self.num))
        under = self._passed(bounds, h, sets[low], band[low] - 1, self.apart(n[low], below[low]))
        return np.append(own[0], under[0]), np.append(own[1], under[1])

    def _passed(self, bounds: np.ndarray, h: np.ndarray, sets: np.ndarray, band: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sets):
            return np.zeros(0, np.int64), np.zeros(0, T.U64)
        n = bounds[sets + 1] - bounds[sets]
        row = np.repeat(np.arange(len(sets)), n)
        h = h[np.repeat(bounds[sets] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(len(row))]
        piece = _piece(h, self.pieces[band][row])
        begin = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])))  # h is sorted, and so piece is
        row, piece = row[begin], piece[begin]
        load = np.diff(np.append(begin, len(h)))
        value = T.mix(np.bitwise_xor.reduceat(T.mix(h + T.U64(T._ODD)), begin) + load.astype(T.U64))
        sig = self._name(value, band[row], piece)
        by = np.lexsort((sig, -load, row))
        full = np.bincount(row, minlength=len(sets))
        place = np.arange(len(row)) - np.append(0, np.cumsum(full))[:-1][row]
        take = by[place <= apart[row]]
        rows, sigs = [sets[row[take]]], [sig[take]]
        for i in np.flatnonzero(full <= apart).tolist():  # few pieces hold a shingle: the empty ones count too
            empty = np.setdiff1d(np.arange(self.pieces[band[i]]), piece[row == i])
            rows.append(np.full(len(empty), sets[i]))
            sigs.append(self._name(np.zeros(len(empty), T.U64), np.full(len(empty), band[i]), empty))
        return np.concatenate(rows), np.concatenate(sigs)

    @staticmethod
    def _name(value: np.ndarray, band: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return T.mix(value + (band.astype(T.U64) << T.U64(40)) + piece.astype(T.U64) * T.U64(T._ODD))


def _piece(h: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    return ((h >> T.U64(32)) * pieces.astype(T.U64) >> T.U64(32)).astype(np.int64)


def _hashes(bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each set, in two words."""
    out = []
    for seed in (0, T._ODD):
        total = np.zeros(len(h) + 1, T.U64)
        np.cumsum(T.mix(T.mix(h) + T.U64(seed)), out=total[1:])
        out.append(T.mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _sketch(bounds: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """256-bit parity sketch of each set, in four words."""
    word = (h >> T.U64(24)) & T.U64(3)
    out = []
    for i in range(4):
        flip = np.append(T.U64(0), np.where(word == T.U64(i), T.U64(1) << ((h >> T.U64(18)) & T.U64(63)), T.U64(0)))
        total = np.bitwise_xor.accumulate(flip)
        out.append((total[bounds[1:]] ^ total[bounds[:-1]]).view(np.int64))
    return out


def _row_hash(g1: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hash of a row's set and doc_id, by which one row of each set is chosen."""
    return T.mix(g1.view(T.U64) ^ ids.view(T.U64)).view(np.int64)


def _scan(docs: DataFrame, k: int, schema: str, rows):  # noqa: ANN001, ANN202
    """``rows(batch's rows, hashes of doc_ids, bounds, hashes)`` of every chunk of texts."""
    names = [x.split()[0] for x in schema.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2).to_numpy()
            for c in T.chunks(b.column(1)):
                out = rows(b.slice(c.lo, c.hi - c.lo), ids[c.lo : c.hi], *_sets(c, k))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k"), F.xxhash64("text").alias("t")).mapInArrow(build, schema)


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row hash p, text hash t, set size n, set hashes g1 and g2 and 256-bit sketch of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batch, ids, bounds, h):  # noqa: ANN001, ANN202
        g1, g2 = _hashes(bounds, h)
        return batch.column(0), _row_hash(g1, ids), batch.column(3), np.diff(bounds), g1, g2, *_sketch(bounds, h)

    return _scan(docs, k, f"doc_id {kind}, p long, t long, n long, g1 long, g2 long, {', '.join(f'{x} long' for x in SKETCH)}", rows)


def _filter(hashes: DataFrame):  # noqa: ANN202
    """Filter of fixed size that all ``hashes`` (one column) pass, as a broadcast of bits."""
    column = hashes.columns[0]
    slots = hashes.select(F.shiftrightunsigned(column, 64 - WANT_BITS).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    want = np.zeros(1 << WANT_BITS, bool)
    want[slots] = True
    return hashes.sparkSession.sparkContext.broadcast(np.packbits(want))


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h.view(T.U64) >> T.U64(64 - WANT_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def signed(docs: DataFrame, first, threshold: Fraction, k: int, among=None) -> DataFrame:  # noqa: ANN001
    """(sig, g1, g2): the pieces that sets pass on.

    ``first`` is a filter of the rows (by row hash) that speak for their sets: a
    copy that passes it too gives the same rows again, which change no bucket.
    ``among`` is a filter of signatures.
    """

    def rows(batch, ids, bounds, h):  # noqa: ANN001, ANN202
        g1, g2 = _hashes(bounds, h)
        on = np.flatnonzero(_passes(first.value, _row_hash(g1, ids)) & (np.diff(bounds) > 0))
        size = np.diff(bounds)[on]
        ends = np.append(0, np.cumsum(size))
        row, sig = Scheme(threshold).signatures(ends, h[np.repeat(bounds[on] - ends[:-1], size) + np.arange(ends[-1])])
        if among is not None:
            hit = _passes(among.value, sig)
            row, sig = row[hit], sig[hit]
        return (sig.view(np.int64), g1[on[row]], g2[on[row]]) if len(row) else None

    return _scan(docs, k, "sig long, g1 long, g2 long", rows)


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the ``nodes`` (id, p, g1, g2): a scan that passes rows by a filter of fixed size, then a join."""
    wanted = _filter(nodes.select("p"))

    def rows(batch, ids, bounds, h):  # noqa: ANN001, ANN202
        g1, g2 = _hashes(bounds, h)
        on = np.flatnonzero(_passes(wanted.value, _row_hash(g1, ids)) & (np.diff(bounds) > 0))
        if not len(on):
            return None
        size = np.diff(bounds)[on]
        ends = np.append(0, np.cumsum(size))
        take = np.repeat(bounds[on] - ends[:-1], size) + np.arange(ends[-1])
        return g1[on], g2[on], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[take].view(np.int64)))

    found = _scan(docs, k, "g1 long, g2 long, shingles array<long>", rows)
    return found.join(nodes.select("id", "g1", "g2"), ["g1", "g2"]).dropDuplicates(["id"]).select("id", "shingles")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity reaches the threshold."""
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    union = F.size("x") + F.size("y") - both
    return joined.filter(F.lit(threshold.denominator) * both >= F.lit(threshold.numerator) * union).select("a", "b")


def _grouped(docs: DataFrame, threshold: Fraction, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row with its set's hashes, and every set (g1, g2) with its component's ``head``, the smallest row of all its sets."""
    rows = written(sketched(docs, k), "rows")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t")).alias("first")
    best = F.min_by(F.struct("p", "n", *SKETCH), "p").alias("s")
    nodes = written(rows.filter("n > 0").groupBy("g1", "g2").agg(head, best).select("g1", "g2", "first", "s.*").withColumn("id", F.monotonically_increasing_id()), "nodes")
    labels = linked(docs, nodes, threshold, k)
    joined = nodes.select("id", "g1", "g2", "first").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    heads = joined.groupBy("comp").agg(F.min("first").alias("head"))
    named = joined.join(heads, "comp").select("g1", "g2", "head")
    return rows.select("doc_id", "t", "n", "g1", "g2"), named


def near_duplicates(docs: DataFrame, threshold: Fraction | str = "0.8", k: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    rows, named = _grouped(docs, Fraction(threshold), k)
    out = rows.join(named, ["g1", "g2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def linked(docs: DataFrame, nodes: DataFrame, threshold: Fraction, k: int) -> DataFrame:
    """(id, comp) of the ``nodes`` that share a piece with another: equal for those that links connect."""
    first = _filter(nodes.select("p"))
    pieces = signed(docs, first, threshold, k).groupBy("sig").agg(F.min("g1").alias("low"), F.max("g1").alias("high"))
    shared = written(pieces.filter("low <> high").select("sig"), "shared-pieces")
    among = _filter(shared)
    some = signed(docs, first, threshold, k, among).join(shared, "sig").join(nodes.select("id", "g1", "g2"), ["g1", "g2"])
    buckets = written(some.select("sig", "id").distinct(), "buckets")
    first.destroy()
    among.destroy()
    sizes = buckets.groupBy("sig").agg(F.count("id").alias("size"))
    central = buckets.join(sizes, "sig").groupBy("id").agg(F.sum("size").alias("score"))
    members = written(nodes.drop("first").join(central, "id"), "members")
    sets = written(full_sets(docs, members, k), "shingles")
    apart = float((1 - threshold) / (1 + threshold))

    def distance(a: str, b: str) -> Column:
        return sum((F.bit_count(F.col(a + x).bitwiseXOR(F.col(b + x))) for x in SKETCH), F.lit(0))

    def near(a: str, b: str) -> Column:
        """Different components, sizes that may match, and sketches within the largest symmetric difference of a pair."""
        n, m = F.col(f"{a}n"), F.col(f"{b}n")
        sizes = F.least(n, m) * threshold.denominator >= F.greatest(n, m) * threshold.numerator
        return (F.col(a + "comp") != F.col(b + "comp")) & sizes & (distance(a, b) <= F.floor(F.lit(apart) * (n + m) + 1e-9))

    carried = ["id", "n", "comp", *SKETCH]
    labels = written(members.select("id", F.col("id").alias("comp")), "labels")
    tested = None
    for step in range(ROUNDS + 1):
        placed = buckets.join(members.drop("p", "g1", "g2").join(labels, "id"), "id")
        order = F.col("score") if step == 0 else F.xxhash64("id", F.lit(step))
        open_ = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by(F.struct(*carried), F.struct(order, "id")).alias("c"), F.max(order).alias("rank")).filter("low <> high")
        if step < ROUNDS:
            held = placed.alias("x").join(open_, "sig").filter(near("x.", "c.")).select(F.col("x.id").alias("x"), F.col("c.id").alias("y"), (F.col("rank") if step == 0 else -distance("x.", "c.")).alias("rank"))
            pairs = held.groupBy("x").agg(F.max_by("y", F.struct("rank", "y")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        else:
            left = placed.join(open_.select("sig"), "sig", "left_semi").select("sig", *carried)
            x, y = left.alias("x"), left.alias("y")
            held = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.id") < F.col("y.id")) & near("x.", "y."))
            pairs = held.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        pairs = pairs.distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():  # nothing to compare: the sets aren't joined for it
            dropped(pairs)
            continue
        tested = pairs if tested is None else tested.union(pairs)
        links = written(verified(pairs, sets, threshold), "links")
        if not links.isEmpty():
            named = labels.toDF("id", "c")
            ends = links.join(named.toDF("a", "ca"), "a").join(named.toDF("b", "cb"), "b")
            joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("old", "new")
            old, labels = labels, written(labels.join(joined, labels["comp"] == F.col("old"), "left").select("id", F.coalesce("new", "comp").alias("comp")), "labels")
            dropped(old)
        dropped(links)
    dropped(shared, buckets, members, sets)
    return labels


def op2_parity_join(docs: DataFrame) -> DataFrame:
    """3-word shingles, Jaccard of 90 % at least."""
    return near_duplicates(docs.select("doc_id", "text"), Fraction(9, 10), 3)


def near_duplicate_stage(docs: DataFrame, threshold: Fraction | str = "0.8", k: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their group; columns unchanged.

    A group's row is that of the smallest (doc_id, hash of the text), a null id
    after all others; of repeated rows with that id and text one stays.  Texts
    without a word stay.
    """
    rows, named = _grouped(docs.select("doc_id", "text"), Fraction(threshold), k)
    worded = rows.filter("n > 0")
    out = worded.join(named, ["g1", "g2"]).filter("not (doc_id <=> head.doc_id and t = head.t)").select("doc_id", "t")
    key = lambda found: found.groupBy(F.col("doc_id").alias("_docloom_id"), F.col("t").alias("_docloom_t")).count()
    text = F.xxhash64(docs["text"])
    on = lambda found: docs["doc_id"].eqNullSafe(found["_docloom_id"]) & (text == found["_docloom_t"])
    gone, several = key(out), written(key(worded).filter("count > 1"), "repeated")
    kept = docs.join(gone.hint("merge"), on(gone), "left_anti")
    if several.isEmpty():
        return kept
    one = kept.join(several, on(several)).dropDuplicates(["_docloom_id", "_docloom_t"]).select(*[docs[c] for c in docs.columns])
    return kept.join(several, on(several), "left_anti").union(one)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
reach AS (SELECT x AS doc_id, y AS r FROM l UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON l.x = reach.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(reach.r)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""
