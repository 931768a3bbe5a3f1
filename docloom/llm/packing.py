"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are whole numbers up to the largest permitted capacity, so best-fit
decreasing needs only the number of pieces of each length: the driver packs
this histogram in groups of equal bins (its size depends on the capacities,
never on the corpus) and each piece finds its bin by its rank among the pieces
of its length.  Where no open bin fits, the size of least cost for what it is
expected to hold is opened; at the end each bin shrinks to the smallest
permitted capacity that holds its contents.  The rule for opening competes
with the plain ones (always the largest, always the smallest that fits) and
the cheapest packing of all three is kept.

A document longer than the largest capacity is cut into pieces of it and a rest.

Cases: a null or empty text has length 1, its end mark; null ids, ties and
repeated rows are packed row by row (equal rows are interchangeable); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import written

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin besides its capacity, in tokens.
OVERHEAD = 32
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Plan:
    """Placements (length, first rank, number, first bin, offset) sorted by length and rank; bin ranges with their final capacity."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    first_bin: np.ndarray
    capacity: np.ndarray
    cost: int


def _packed(histogram: Sequence[int], capacities: Sequence[int], overhead: int, rule: str) -> Plan:
    """Best-fit decreasing over ``histogram[length]`` with one rule for opening bins."""
    free: dict[int, list[tuple[int, int, int]]] = {}  # room left: (first bin, number, capacity when opened)
    rooms: list[int] = []  # sorted keys of free
    places: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def add(room: int, group: tuple[int, int, int]) -> None:
        if room not in free:
            rooms.insert(bisect_left(rooms, room), room)
            free[room] = []
        free[room].append(group)

    count = np.asarray(histogram, np.int64)
    tokens = np.cumsum(count * np.arange(len(count)))  # tokens in pieces up to each length
    for length in range(len(count) - 1, 0, -1):
        rank, left = 0, int(count[length])
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, number, size = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
                n = min(left, number)
                if n < number:
                    add(room, (first + n, number - n, size))
            else:
                fits = [c for c in capacities if c >= length]

                def unit_cost(c: int, length: int = length, left: int = left) -> float:
                    each = min(c // length, left)
                    n = -(-left // each)
                    spare = c - each * length
                    return (c + overhead) / min(c, each * length + float(tokens[min(spare, length - 1)]) / n)

                size = fits[0] if rule == "smallest" else fits[-1] if rule == "largest" else min(fits, key=lambda c: (unit_cost(c), -c))
                first, room = bins, size
                n = max(left // (size // length), 1) if left >= size // length else 1
                bins += n
                each = min(size // length, left)
                for j in range(each):
                    places.append((length, rank, n, first, j * length))
                    rank += n
                left -= n * each
                if room - each * length:
                    add(room - each * length, (first, n, size))
                else:
                    free.setdefault(0, []).append((first, n, size))
                continue
            places.append((length, rank, n, first, size - room))
            rank, left = rank + n, left - n
            if room - length:
                add(room - length, (first, n, size))
            else:
                free.setdefault(0, []).append((first, n, size))
    done = sorted((first, number, min(c for c in capacities if c >= size - room)) for room, groups in free.items() for first, number, size in groups)
    places.sort()
    col = lambda rows, i: np.array([r[i] for r in rows], np.int64)
    return Plan(col(places, 0), col(places, 1), col(places, 3), col(places, 4), col(done, 0), col(done, 2), sum(n * (c + overhead) for _, n, c in done))


def plan(histogram: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """The cheapest packing among the rules for opening bins."""
    capacities = sorted(capacities)
    return min((_packed(histogram, capacities, overhead, rule) for rule in ("least cost", "largest", "smallest")), key=lambda p: p.cost)


def lengths_of(docs: DataFrame) -> DataFrame:
    """doc_id and length: words of the text, and one for its end mark."""
    return docs.select("doc_id", (F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) + 1).cast("long").alias("length"))


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Rows (doc_id, length) to rows (doc_id, piece, length, bin_id, bin_offset, capacity)."""
    most = max(capacities)
    spark = lengths.sparkSession
    number = F.ceil(F.col("length") / most).cast("int")
    pieces = lengths.filter("length > 0").select("doc_id", "length", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(most), F.col("length") - F.col("piece") * most).cast("int").alias("length"))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            part = pa.array(np.full(b.num_rows, TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, part, pa.array(at + np.arange(b.num_rows))], [*b.schema.names, "part", "at"])
            at += b.num_rows

    keys = ["length", "doc_id", "piece"]
    ordered = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(stamp, f"doc_id {kind}, piece int, length int, part int, at long")
    ordered = written(ordered, "pieces")
    parts = dict(ordered.groupBy("part").count().collect())  # a row for each task
    histogram = np.zeros(most + 1, np.int64)
    for length, n in ordered.groupBy("length").count().collect():  # a row for each length up to the largest capacity
        histogram[length] = n
    before = np.append(0, np.cumsum(histogram))  # pieces shorter than each length
    offset, total = {}, 0
    for part in sorted(parts):
        offset[part] = total
        total += parts[part]
    shared = spark.sparkContext.broadcast((plan(histogram, capacities, overhead), before, offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, before, offset = shared.value
        key = p.length << 40 | p.rank
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(2).to_numpy().astype(np.int64)
            start = np.array([offset[x] for x in b.column(3).to_pylist()], np.int64)
            rank = start + b.column(4).to_numpy() - before[length]
            k = np.searchsorted(key, length << 40 | rank, "right") - 1
            found = p.bin[k] + rank - p.rank[k]
            size = p.capacity[np.searchsorted(p.first_bin, found, "right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found), pa.array(p.offset[k]), pa.array(size)], ["doc_id", "piece", "length", "bin_id", "bin_offset", "capacity"])

    return ordered.mapInArrow(place, f"doc_id {kind}, piece int, length int, bin_id long, bin_offset long, capacity long")


def op3_best_fit(docs: DataFrame) -> DataFrame:
    """Every piece of every document with its bin."""
    return pack(lengths_of(docs))
