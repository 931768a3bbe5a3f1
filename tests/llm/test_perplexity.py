import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from docloom.llm import perplexity as P
from docloom.llm import textops as T
from tests.llm.helpers import SCHEMA, corpus, words


def base(text):
    w, text = words(text), text or ""
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cover, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            cover |= set(range(i, i + 5))
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_statistics_and_verdict(spark):
    rows = corpus()
    got = P.op1_perplexity(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert (r.log_ppl is None) == (not texts[r.doc_id])


def test_model_against_direct_formula():
    """Interpolated modified Kneser-Ney, worked out with dictionaries."""
    texts = ["the other then", "then the hen", "he ate", "tatata", ""]
    cls = lambda t: [0] * 3 + [int(P.CLASS[b]) for b in t.encode()]
    grams = Counter(tuple(s[i : i + 4]) for t in texts for s in [cls(t)] for i in range(len(s) - 3))
    counts = {4: grams}
    for n in (3, 2, 1):
        low = Counter()
        for g, c in counts[n + 1].items():
            if g[1] == 0 and n > 1 or n == 1 and g[1] == 0:
                low[g[1:]] += c if g[0] == 0 else 0
            else:
                low[g[1:]] += 1
        counts[n] = low

    def prob(g):
        n = len(g)
        if not n:
            return 1 / P.V
        have = [max(sum(c == i for c in counts[n].values()), 1) for i in range(1, 5)]
        y = have[0] / (have[0] + 2 * have[1])
        cut = [0] + [min(max(i - (i + 1) * y * have[i] / have[i - 1], 0.05), 0.95 * i) for i in (1, 2, 3)]
        same = [c for h, c in counts[n].items() if h[:-1] == g[:-1]]
        if not same:
            return prob(g[1:])
        c = counts[n].get(g, 0)
        return (c - cut[min(c, 3)]) / sum(same) + sum(cut[min(x, 3)] for x in same) / sum(same) * prob(g[1:])

    keys = np.concatenate([P.ngram_keys(c) for c in T.chunks(pa.array(texts))])
    key, n = np.unique(keys, return_counts=True)
    model = P.estimate(key, n)
    for text in [*texts, "zebra theta"]:
        s = cls(text)
        want = [math.log(prob(tuple(s[i : i + 4]))) for i in range(len(s) - 3)]
        [c] = T.chunks(pa.array([text]))
        assert np.allclose(model.lookup(P.ngram_keys(c)), want, atol=1e-4)


def test_bands_reject_noise_and_keep_prose(spark):
    rows = [r for r in corpus(300, 3) if r[1] and len(r[1]) > 200]
    noise = [(10_000 + i, "%$#@ ^^^ QXZJ&& " * 40 + str(i), "en", "s", 0) for i in range(3)]
    noise = [(i, " ".join(f"%${(i * k) % 97}#@ Q{(k * k) % 89}ZX&" for k in range(40)), "en", "s", 0) for i, *_ in noise]
    got = {r.doc_id: r for r in P.op1_perplexity(spark.createDataFrame(rows + noise, SCHEMA)).collect()}
    assert not any(got[n[0]].kept for n in noise)
    good = [got[r[0]] for r in rows if not got[r[0]].base_failed]
    assert sum(r.kept for r in good) > 0.95 * len(good)
    kept = {r.doc_id for r in P.quality_stage(spark.createDataFrame(rows + noise, SCHEMA)).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.op1_perplexity(empty).count() == 0
    more = spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "1 as kept", "'x' as row", "2 as log_ppl", "3 as `a b`")
    out = P.quality_stage(more)
    assert out.columns == more.columns and out.count() > 0


def test_every_code_point_counts(spark):
    """The distributed model against the one of one process, on scripts whose characters byte classes don't tell apart."""
    rng = random.Random(3)
    words_ = ["наука", "город", "ABBA", "1984", "中文字符", "語言模型", "العربية", "😀😁"]
    texts = [" ".join(rng.choice(words_) for _ in range(rng.randint(1, 30))) for _ in range(60)] + [None, "", "a"]
    keys = np.concatenate([P.ngram_keys(c) for c in T.chunks(pa.array(texts))])
    key, n = np.unique(keys, return_counts=True)
    assert {chr(int(x) - 1) for x in key["symbol"]} == set("".join(t or "" for t in texts))
    model = P.estimate(key, n)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in P.op1_perplexity(docs).collect():
        if t := texts[r.doc_id]:
            [c] = T.chunks(pa.array([t]))
            assert abs(r.log_ppl + model.lookup(P.ngram_keys(c)).mean()) < 1e-5


def test_scrambled_text_of_any_script_is_worse_than_prose(spark):
    rng = random.Random(4)
    for first, size in ((0x4E00, 2000), (0x430, 32), (0x627, 36)):
        letters = [chr(first + i) for i in range(size)]
        words_ = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(120)]
        texts = [" ".join(rng.choice(words_) for _ in range(150)) for _ in range(80)]
        garbage = "".join(" " if x == " " else rng.choice(letters) for x in texts[0])
        docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate([*texts, garbage])], SCHEMA)
        got = {r.doc_id: r for r in P.op1_perplexity(docs).collect()}
        assert not got[80].kept and sum(r.kept for r in got.values()) > 70


def test_a_model_too_large_to_send(spark, monkeypatch):
    """Blocks of texts that meet their part of the model give the same rows."""
    docs = spark.createDataFrame(corpus(60, 9), SCHEMA).repartition(3)
    key = lambda r: (r.doc_id, r.n_words)
    sent = sorted(P.op1_perplexity(docs).collect(), key=key)
    monkeypatch.setattr(P, "MOST", 0)
    monkeypatch.setattr(P, "BLOCK", 1 << 12)
    met = sorted(P.op1_perplexity(docs).collect(), key=key)
    assert [tuple(r)[:-1] for r in sent] == [tuple(r)[:-1] for r in met]
    assert all(a.log_ppl is b.log_ppl is None or abs(a.log_ppl - b.log_ppl) < 1e-5 for a, b in zip(sent, met, strict=True))


def test_owners_of_ngrams_in_one_chunk():
    """An n-gram belongs to a text (and its copies) only if no other text has it."""
    texts = ["abcdef", "abcxyz", "abcdef", "qqqq", "abcdef", None, ""]
    [c] = T.chunks(pa.array(texts))
    h, context, symbol, n, owner = P._counted(c)
    context_, symbol_, _ = P.ngrams(c)
    every = P._hash(context_, symbol_)
    text = np.repeat(P._text_hash(c), [len(t or "") for t in texts])
    for i, g in enumerate(h):
        who = set(text[every == g].tolist())
        assert n[i] == (every == g).sum() and owner[i] == (who.pop() if len(who) == 1 else 0)
