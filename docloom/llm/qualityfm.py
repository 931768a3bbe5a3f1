"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)):
the pairwise interactions of all features in time linear in their number.

It is fitted on at most ``sample`` labelled rows, those of smallest hash, whose
features (never texts) go to the driver; every whole text is then scored on
the executors.  Words count once each; statistics and metadata are put in bins.

Cases: a null or empty text is scored by its statistics; repeated rows are
scored row by row; labelled ids that several rows have give one example each;
null labels and labels without a document are ignored; without any labelled row
all scores are 0.5; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textops as T
from docloom.llm.perplexity import base_statistics

WORD_BITS, FACTORS = 15, 8
#: Labelled rows to fit on at most.
SAMPLE = 16_000
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.1, 1e-5
#: Upper ends of the bins of each statistic; one more bin takes the rest.
EDGES = {
    "log_words": [1, 2, 3, 4, 5, 6, 7, 8],
    "log_chars": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    "chars_per_word": [2, 3, 4, 5, 6, 7, 8, 10, 15],
    "symbols_per_word": [0, 0.01, 0.03, 0.1, 0.3, 0.6, 1, 2],
    "upper_share": [0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7],
    "digit_share": [0, 0.001, 0.01, 0.03, 0.1, 0.3],
    "punctuation_per_word": [0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "bang_per_word": [0, 0.005, 0.02, 0.1, 0.5],
    "words_per_line": [1, 2, 4, 8, 16, 32, 64, 128],
    "dup_line_share": [0, 0.05, 0.1, 0.2, 0.4, 0.7],
    "repeat_share": [0, 0.02, 0.05, 0.1, 0.2, 0.5],
    "distinct_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "wide_share": [0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3],
}
SIZE = (1 << WORD_BITS) + sum(len(e) + 1 for e in EDGES.values())


def features(c: T.Chunk, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, feature, value): the features of each text; ``n_chars`` is the metadata column (NaN: unknown)."""
    n = len(c.offs) - 1
    w = T.words(c, True)
    key = np.unique(w.doc.astype(np.uint64) << T.U64(WORD_BITS) | (w.hash >> T.U64(64 - WORD_BITS)))
    doc, word = (key >> T.U64(WORD_BITS)).astype(np.int64), (key & T.U64((1 << WORD_BITS) - 1)).astype(np.int64)
    distinct = np.bincount(doc, minlength=n)
    stats = base_statistics(c)
    words = np.maximum(stats["n_words"], 1)
    size = np.maximum(np.diff(c.offs), 1)
    count = lambda mask: T.sums(mask.astype(np.int8), c.offs)
    buf = c.buf
    line = np.bincount(T.lines(c)[0], minlength=n)
    value = {
        "log_words": np.log1p(stats["n_words"]),
        "log_chars": np.log1p(np.where(np.isnan(n_chars), stats["word_chars"], n_chars)),
        "chars_per_word": stats["word_chars"] / words,
        "symbols_per_word": stats["n_symbols"] / words,
        "upper_share": count((buf >= 65) & (buf <= 90)) / size,
        "digit_share": count((buf >= 48) & (buf <= 57)) / size,
        "punctuation_per_word": count((buf == 44) | (buf == 46) | (buf == 58) | (buf == 59)) / words,
        "bang_per_word": count((buf == 33) | (buf == 63)) / words,
        "words_per_line": stats["n_words"] / np.maximum(line, 1),
        "dup_line_share": stats["n_dup_lines"] / np.maximum(line, 1),
        "repeat_share": stats["n_repeat_words"] / words,
        "distinct_share": distinct / words,
        "wide_share": count(buf >= 0xC0) / size,
    }
    bins, base = [], 1 << WORD_BITS
    for name, edges in EDGES.items():
        bins.append(base + np.searchsorted(edges, value[name], "left"))
        base += len(edges) + 1
    rows = np.append(doc, np.tile(np.arange(n), len(bins)))
    feature = np.append(word, np.concatenate(bins))
    x = np.append(1 / np.sqrt(np.maximum(distinct, 1))[doc], np.full(n * len(bins), 0.5))
    by = np.argsort(rows, kind="stable")
    return T.bounds_of(rows[by], n), feature[by], x[by]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def score(self, bounds: np.ndarray, feature: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._parts(bounds, feature, x)[0])

    def _parts(self, bounds: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[feature] * x[:, None]
        at = bounds[:-1]  # every text has its statistics, so none is empty
        total = np.add.reduceat(vx, at)
        square = np.add.reduceat(vx * vx, at)
        return self.bias + np.add.reduceat(self.weight[feature] * x, at) + 0.5 * (total * total - square).sum(1), total, vx


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss by Adagrad over mini-batches."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS)))
    if not len(labels):
        m.factors[:] = 0
        return m
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    m.bias = float(np.log(rate / (1 - rate)))
    gw, gv = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            bounds = np.append(0, np.cumsum([len(rows[k][0]) for k in some]))
            feature = np.concatenate([rows[k][0] for k in some])
            x = np.concatenate([rows[k][1] for k in some])
            z, total, vx = m._parts(bounds, feature, x)
            error = (_sigmoid(z) - labels[some]) / len(some)
            each = np.repeat(np.arange(len(some)), np.diff(bounds))
            e = error[each] * x
            own, place = np.unique(feature, return_inverse=True)
            step = np.bincount(place, e) + DECAY * m.weight[own]
            gw[own] += step * step
            m.weight[own] -= RATE * step / np.sqrt(gw[own])
            pull = e[:, None] * (total[each] - vx)
            step = np.stack([np.bincount(place, pull[:, f]) for f in range(FACTORS)], 1) + DECAY * m.factors[own]
            gv[own] += step * step
            m.factors[own] -= RATE * step / np.sqrt(gv[own])
            m.bias -= RATE * float(error.sum())
    return m


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the documents of at most ``sample`` labelled ids that aren't held out."""
    usable = labels.filter("doc_id is not null and quality is not null").filter(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.select(F.col("doc_id").alias("label_id"), "quality")
    # at most ``sample`` ids of 12 bytes are broadcast
    found = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("label_id")).select("text", docs["n_chars"].cast("double").alias("n_chars"), "quality", "label_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in T.chunks(b.column(0)):
                bounds, feature, x = features(c, b.column(1)[c.lo : c.hi].to_numpy(zero_copy_only=False).astype(float))
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(v)) for v in (feature.astype(np.int32), x.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column(3)[c.lo : c.hi], b.column(2)[c.lo : c.hi].cast(pa.int32()), *lists], ["id", "y", "f", "x"])

    # one example for each id, however many rows have it
    got = found.mapInArrow(extract, "id long, y int, f array<int>, x array<float>").groupBy("id").agg(F.min(F.struct("y", "f", "x")).alias("r")).select("id", "r.*").orderBy("id").toArrow()
    fs, xs = got["f"].combine_chunks(), got["x"].combine_chunks()
    rows = [(f.values.to_numpy(), x.values.to_numpy().astype(float)) for f, x in zip(fs, xs, strict=True)]
    return fit(rows, got["y"].to_numpy().astype(float))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Machine(machine.bias, machine.weight.astype(np.float32), machine.factors.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in T.chunks(b.column(1)):
                bounds, feature, x = features(c, b.column(2)[c.lo : c.hi].to_numpy(zero_copy_only=False).astype(float))
                yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], pa.array(shared.value.score(bounds, feature, x.astype(np.float32)).astype(float))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.col("n_chars").cast("double")).mapInArrow(score, f"doc_id {kind}, score double")


def op5_factorisation_machine(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality score of every document, learnt from the labelled ids that aren't held out."""
    docs = docs.select("doc_id", "text", "n_chars")
    out = scored(docs, train(docs, labels.select("doc_id", "quality")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
