import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from docloom.llm import langid as L
from docloom.llm import qualityfm as Q
from docloom.llm import textops as T
from tests.llm.helpers import SCHEMA, corpus, sentence


def test_fm_identity_and_features():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    m = Q.Machine(0.3, rng.normal(size=Q.SIZE), rng.normal(size=(Q.SIZE, Q.FACTORS)))
    [c] = T.chunks(pa.array(["One two two, three!", "", None, "## aa"]))
    bounds, feature, x = Q.features(c, np.array([19, np.nan, np.nan, 5]))
    got = m.score(bounds, feature, x)
    for i in range(4):
        f, v = feature[bounds[i] : bounds[i + 1]], x[bounds[i] : bounds[i + 1]]
        z = m.bias + (m.weight[f] * v).sum() + sum(m.factors[f[a]] @ m.factors[f[b]] * v[a] * v[b] for a in range(len(f)) for b in range(a))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert np.diff(bounds).tolist() == [4 + len(Q.EDGES), len(Q.EDGES), len(Q.EDGES), 2 + len(Q.EDGES)]


def test_fm_learns_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        text = sentence(rng, rng.randint(20, 80))
        rows.append((i, text if good else " ".join(w + "%%%" for w in text.split()), "en", "s", len(text)))
        labels.append((i, int(good), 0))
    labels += [(9999, 1, 0), (None, 1, 0), (5, None, 0)]
    rows += [(500, None, None, None, None), (501, "", None, None, 0), rows[3]]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.op5_factorisation_machine(docs, marks).collect()
    truth = {a: b for a, b, _ in labels if b is not None}
    assert len(got) == len(rows)
    hits = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in truth:
            hits.append((r.score >= 0.5) == truth[r.doc_id])
    assert np.mean(hits) > 0.95
    none = Q.op5_factorisation_machine(docs, marks.filter("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.op5_factorisation_machine(docs.filter("false"), marks).count() == 0


def greedy(text, ref):
    """Cross-parsing by substring search, segment by segment."""
    n = 0
    for s in range(0, len(text), L.SEGMENT):
        part, i = text[s : s + L.SEGMENT], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in ref:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
    return n


def test_automaton_gives_longest_matches():
    rng = random.Random(4)
    refs = {x: "".join(rng.choice(a) for _ in range(300)) for x, a in (("aa", "abcd "), ("bb", "abxy "), ("cc", "b"))}
    texts = ["".join(rng.choice("abcdxyz ") for _ in range(n)) for n in (1, 5, 255, 256, 257, 900)] + [""]
    p = L.build(refs)
    for c in T.chunks(pa.array(texts), 500):
        count, size, _ = p.phrases(c)
        for i in range(len(size)):
            assert count[i].tolist() == [greedy(texts[c.lo + i], refs[x]) for x in p.names]


def test_languages_on_held_out_rows(spark):
    rng = random.Random(5)
    kinds = {"en": ["the", "and", "ing", "er", " "], "fr": ["que", "é", "eau", "ou", " "], "de": ["sch", "ü", "ung", "ein", " "]}
    rows = [(i, "".join(rng.choice(kinds[x]) for _ in range(rng.randint(30, 200))), x, "s", 0) for i in range(240) for x in [rng.choice(list(kinds))]]
    odd = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 ... !", "fr", "s", 0), (903, "the thing and the", None, "s", 0), (None, "einung", "de", "s", 0), rows[0]]
    got = L.op6_cross_parsing(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.98
    blind = spark.createDataFrame([(1, "abc", None, "s", 0)], SCHEMA)
    assert [tuple(r)[2:] for r in L.op6_cross_parsing(blind).collect()] == [("und", 0.0)]
    assert L.op6_cross_parsing(blind.filter("false")).count() == 0
    assert L.op6_cross_parsing(spark.createDataFrame(corpus(20), SCHEMA)).count() == 30


def test_rare_characters_and_later_text_are_learnt(spark):
    """Languages told apart only by ideographs beyond the 120 most frequent characters of the references."""
    rng = random.Random(6)
    common = "".join(chr(0x3041 + i) for i in range(80)) + "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOP"
    own = {"ja": [chr(0x4E00 + i) for i in range(300)], "zh": [chr(0x6E00 + i) for i in range(300)]}
    texts = {x: "".join(rng.choice(own[x]) for _ in range(3000)) + common.lower() * 30 for x in own}
    p = L.build(texts)
    probes = [("zh", "".join(rng.choice(own["zh"]) for _ in range(90))), ("ja", "".join(rng.choice(own["ja"]) for _ in range(90)))]
    [c] = T.chunks(pa.array([t for _, t in probes]))
    count, _, _ = p.phrases(c)
    assert count.tolist() == [[greedy(t, texts[x]) for x in p.names] for _, t in probes]
    assert p.predict(c)[0] == [x for x, _ in probes]


def test_whole_sampled_texts_teach_whatever_the_number_of_languages(spark):
    rows = [(i, f"{'w' * 700} " * 90 + f"end{i}", f"l{i % 9}", "s", 0) for i in range(60)]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    got = L.references(spark.createDataFrame(rows, SCHEMA))
    assert all(r[1] in got[r[2]] for r in kept)
    p = L.build(got)
    [c] = T.chunks(pa.array([f"end{r[0]}" for r in kept]))
    count, _, _ = p.phrases(c)
    assert all(count[i][p.names.index(r[2])] == 1 for i, r in enumerate(kept))


def test_the_parser_is_built_in_little_memory():
    """The driver builds it: what is held meanwhile is one automaton and a few arrays, not a million strings."""
    rng = random.Random(7)
    refs = {x: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéü ", k=160_000)) for x in ("aa", "bb", "cc", "dd")}
    tracemalloc.start()
    try:
        p = L.build(refs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200e6
    assert p.letter[[ord("a"), ord("É"), 0x4E00, 0x20000]].all() and not p.letter[[ord("1"), ord(" "), 0x10FFFF, -1]].any()
    assert p.code[ord("É")] == p.code[ord("é")] > 0 and p.code[ord("\n")] == p.code[ord(" ")] > 0 == p.code[0x4E00]
