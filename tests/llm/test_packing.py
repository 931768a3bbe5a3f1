import random
from collections import defaultdict

import numpy as np

from docloom.llm import packing as P
from tests.llm.helpers import SCHEMA, corpus, words


def sequential(items, capacities, overhead, largest=True):
    """Best-fit decreasing, one item at a time, opening the largest (or smallest fitting) capacity."""
    bins = []
    for x in sorted(items, reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= x]
        if not fit:
            fit = [[max(capacities) if largest else min(c for c in capacities if c >= x), 0]]
            bins.append(fit[0])
        b = min(fit, key=lambda b: b[0] - b[1])
        b[1] += x
    return sum(min(c for c in capacities if c >= used) + overhead for _, used in bins)


def test_plan_matches_one_at_a_time():
    rng = random.Random(1)
    for trial in range(60):
        caps = rng.choice([(10,), (8, 16), (5, 9, 20), (16, 32, 64)])
        items = [rng.randint(1, max(caps)) for _ in range(rng.randint(0, 120))]
        histogram = np.bincount(items, minlength=max(caps) + 1) if items else np.zeros(max(caps) + 1, int)
        for rule in ("largest", "smallest"):
            assert P._packed(histogram, sorted(caps), 3, rule).cost == sequential(items, caps, 3, rule == "largest"), (trial, caps, rule)
        best = P.plan(histogram, caps, 3)
        assert best.cost <= min(sequential(items, caps, 3, x) for x in (True, False))
        assert best.cost >= sum(items)


def test_bins_hold_every_piece_once(spark):
    rows = corpus(150, 7)
    got = P.op3_best_fit(spark.createDataFrame(rows, SCHEMA)).collect()
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(len(words(r[1])) + 1)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.doc_id] += r.length
        assert r.length <= max(P.CAPACITIES)
    assert sizes == {k: sum(v) for k, v in want.items()}
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert {r.capacity for r in b} == {min(c for c in P.CAPACITIES if c >= at)}


def test_empty_and_long(spark):
    assert P.op3_best_fit(spark.createDataFrame([], SCHEMA)).count() == 0
    lengths = spark.createDataFrame([(None, 10_000), (1, 4096), (2, 0)], "doc_id long, length long").selectExpr("*", "1 as part", "2 as piece2")
    got = P.pack(lengths).collect()
    assert sorted(r.length for r in got) == [1808, 4096, 4096, 4096]
