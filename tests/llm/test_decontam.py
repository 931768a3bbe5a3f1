import random

import numpy as np

from docloom.llm import decontam as D
from tests.llm.helpers import sentence, word


def distance(item, text):
    """Edit distance of item to its nearest substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def fold(t):
    return "".join(" " if c in "\t\n\v\f\r" else c.lower() if c.isascii() else c for c in t or "")


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        t[i : i + (kind != 1)] = [] if kind == 0 else rng.choice("abcé ")
    return "".join(t)


def case(seed=1):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.choice([2, 3, 6, 12, 25]))) for i in range(12)] + [(90, "é" * 9 + "abcdefghij"), (91, None), (92, ""), (93, "short"), (94, "tenletters"), (None, "twenty-four letters here")]
    docs = []
    for i in range(60):
        body = [sentence(rng, rng.choice([0, 5, 40])) for _ in range(3)]
        if i % 2:
            it = items[rng.randrange(13)][1]
            n = rng.choice([0, 0, D.budget(len(it)), D.budget(len(it)) + 1, len(it) // 4])
            body.insert(1, edited(rng, it, n).upper() if i % 3 == 0 else edited(rng, it, n))
        docs.append((i, rng.choice(["\n", " ", ""]).join(body)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (103, items[3][1]), (103, items[3][1]), (104, "word " * 9000 + items[5][1] + "."), (105, items[4][1][:-1]), (None, "x tenlitters y"), (None, "here: twenty four lettrs here")]
    return docs, items


def brute(docs, items):
    out = {}
    for d, t in docs:
        for i, x in items:
            if x and len(x) >= D.Q and t:
                e = distance(fold(x), fold(t)) if len(t) < 5000 else 0 if fold(x) in fold(t) else 99
                if e <= D.budget(len(x)):
                    out[d, i] = e
    return out


def test_against_brute_force(spark):
    docs, items = case()
    frame = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    texts, said = dict(docs), dict(items)
    for block in (D.BLOCK, 100):
        got = D.contaminated(*frame, block=block).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in got} == want and len(want) >= 20
        for r in got:
            if r.edits == 0:
                assert fold(texts[r.doc_id])[r.start : r.end] == fold(said[r.item_id])
    kept = [(r.doc_id, r.text) for r in D.decontamination_stage(*frame).collect()]
    clean = [(d, t) for d, t in docs if (d, t) not in {(d, texts[d]) for d, _ in want} and d is not None]
    assert sorted(kept, key=str) == sorted(clean, key=str)


def test_short_items_and_ids_of_other_types(spark):
    rng = random.Random(7)
    items = [(f"{m}.5", sentence(rng, 12)[:m].replace(" ", "q")) for m in range(8, 44)]
    docs = [(str(i), word(rng) + " " + edited(rng, x, D.budget(len(x)) + i % 2) + " " + word(rng)) for i, (_, x) in enumerate(items * 3)]
    frame = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string").selectExpr("cast(item_id as decimal(6,2)) item_id", "text")
    got = {(r.doc_id, float(r.item_id)): r.edits for r in D.contaminated(*frame).collect()}
    assert got == {(d, float(i)): e for (d, i), e in brute(docs, items).items()} and len(got) >= 50


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "the quick brown fox jumps over the lazy dog again" + " tail" * 400_000
    frame = spark.createDataFrame([(1, text), (2, text[:10])], "doc_id long, text string"), spark.createDataFrame([(1, "The quick brown fix jumps over the lazy dog again")], "item_id long, text string")
    assert [(r.doc_id, r.edits, r.start) for r in D.contaminated(*frame).collect()] == [(1, 1, 2_000_000)]


def test_alignment():
    rng = random.Random(3)
    for _ in range(50):
        item = word(rng) + word(rng) + word(rng)
        text = word(rng) + edited(rng, item, rng.randrange(3)) + word(rng)
        codes = [np.array([ord(c) for c in x]) for x in (item, text)]
        got, _ = D.aligned([codes[0]], [codes[1]], np.array([len(text)]))
        assert got[0] == distance(item, text)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "some text here")], "doc_id long, text string").selectExpr("*", "1 as row", "2 as edits")
    assert D.contaminated(docs, items).count() == D.contaminated(full, items).count() == 0
    assert D.decontamination_stage(full, items).collect() == full.collect()
