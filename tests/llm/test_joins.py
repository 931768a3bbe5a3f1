import math
import random
from fractions import Fraction

import numpy as np
import pytest

from docloom.llm import parityjoin
from docloom.llm.components import components
from docloom.llm.linededup import dedup_lines, op9_line_dedup
from docloom.llm.parityjoin import near_duplicates, near_duplicate_stage
from tests.llm.helpers import SCHEMA, corpus, groups, sentence, shingles, words


def near_brute(rows, num, den, k):
    sets = [shingles(r[1], k) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    top = groups(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        least[top[i]] = min(least.get(top[i], r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[top[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("num,den,k,seed", [(9, 10, 3, 1), (4, 5, 5, 2)])
def test_near_duplicates(spark, num, den, k, seed):
    rows = corpus(150, seed)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), f"{num}/{den}", k).collect()
    assert sorted(map(tuple, got)) == near_brute(rows, num, den, k)
    assert len({r[2] for r in got}) < len(rows)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_near_copies_without_a_common_centre(spark, monkeypatch, rounds):
    """A chain: neighbours link, ends don't; and a group around several centres.  Star rounds or none: the same result."""
    base = [f"w{i}" for i in range(100)]
    chain = [(j, " ".join(base[: 100 - 2 * j] + [f"z{i}" for i in range(2 * j)]), "en", "s", 0) for j in range(12)]
    noisy = [(100 + j, " ".join(f"q{i}" if i != j * 3 else f"y{j}" for i in range(120)), "en", "s", 0) for j in range(30)]
    rows = chain + noisy
    monkeypatch.setattr(parityjoin, "ROUNDS", rounds)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), "9/10", 3).collect()
    assert sorted(map(tuple, got)) == near_brute(rows, 9, 10, 3)


@pytest.mark.parametrize("num,den", [(4, 5), (9, 10), (1, 1)])
def test_pieces_of_pairs_within_the_threshold(num, den):
    """Pigeonhole: sets within the threshold pass on a piece in common, at any sizes."""
    rng, scheme, tried = np.random.default_rng(num), parityjoin.Scheme(Fraction(num, den)), 0
    for _ in range(1500):
        base = rng.integers(0, 1 << 63, int(np.exp(rng.uniform(0, 7)))).astype(np.uint64)
        left = rng.integers(0, len(base) // 8 + 1)
        x, y = np.unique(base), np.unique(np.append(base[left:], rng.integers(0, 1 << 63, rng.integers(0, len(base) // 5 + 1)).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if len(y) and den * both >= num * (len(x) + len(y) - both):
            row, sig = scheme.signatures(np.array([0, len(x), len(x) + len(y)]), np.append(x, y))
            assert len(np.intersect1d(sig[row == 0], sig[row == 1]))
            tried += 1
    assert tried > 100


def test_few_pieces_hold_a_shingle():
    """A set whose shingles fall into few pieces passes on its empty ones too."""
    scheme = parityjoin.Scheme(Fraction(4, 5))
    x = np.arange(40, dtype=np.uint64)  # all in the first piece
    row, sig = scheme.signatures(np.array([0, 40, 79]), np.append(x, x[1:]))
    assert len(np.intersect1d(sig[row == 0], sig[row == 1]))


def test_stage_cases(spark):
    """Null ids, ids that several rows share, repeated rows, a very long text; columns with clashing names."""
    a, b, c = sentence(random.Random(1), 30), sentence(random.Random(2), 30), sentence(random.Random(3), 30)
    long = sentence(random.Random(4), 200_000)
    rows = [(None, a), (None, b), (None, b), (5, a), (5, c), (5, c), (6, c + " more"), (7, long), (8, long + " end"), (9, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as g1", "3 as _id", "4 as t", "5 as k")
    kept = near_duplicate_stage(docs)
    assert kept.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted([(None, b), (5, a), (5, c), (7, long), (9, None), (9, ""), (9, "")], key=key)


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus(80, 5)[:-1]
    kept = near_duplicate_stage(spark.createDataFrame(rows, SCHEMA))
    want = sorted(a for a, _, c in near_brute(rows, 4, 5, 5) if a == c)
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]


def lines_brute(rows, t=0.8):
    seen, gone = [], {}
    for r in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((r[1] or "").split("\n")):
            s = set(words(line, True))
            if s:
                if any((r[0], i) != p and len(s & x) >= t * len(s | x) - 1e-9 for p, x in seen):
                    gone.setdefault(r[0], set()).add(i)
                seen.append(((r[0], i), s))
    return {k: sorted(v) for k, v in gone.items()}


@pytest.mark.parametrize("seed", [1, 4])
def test_line_dedup(spark, seed):
    rows = corpus(120, seed)
    got = op9_line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    want = lines_brute(rows)
    assert len(got) == len(rows) and want
    assert {r.doc_id: r.removed for r in got if r.removed} == want
    texts = {r[0]: r[1] for r in rows}
    for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect():
        old = texts[r.doc_id]
        assert r.text == (None if old is None else "\n".join(x for i, x in enumerate(old.split("\n")) if i not in want.get(r.doc_id, [])))
        assert r.text is None or r.n_chars == len(r.text)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == op9_line_dedup(empty).count() == dedup_lines(empty).count() == 0


def test_null_ids_and_extra_columns(spark):
    rows = [(None, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon"), (3, "alpha beta gamma delta epsilon"), (4, "Other words\nother words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as key", "3 as line", "4 as g")
    assert sorted(r.component_id for r in near_duplicates(docs).collect()) == [3, 3, 3, 4]
    assert dedup_lines(docs).columns == docs.columns
    assert {r.doc_id: r.removed for r in op9_line_dedup(docs).collect()} == {None: [], 3: [0], 4: [1]}


def test_lines_of_rows_that_share_an_id(spark):
    """Rows with one doc_id or none are judged each by its own text."""
    shared = "one line that two of the rows have in common"
    rows = [(None, "unique one two three four\n" + shared), (None, shared + "\nalpha beta gamma"), (2, "x y\nx y"), (2, "q r s\nt u v"), (2, "t u v w\nx y"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as t", "2 as id", "3 as _gone", "4 as prefix")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    lines = [x for _, t in kept if t for x in t.split("\n")]
    assert sorted(lines) == sorted(["unique one two three four", shared, "alpha beta gamma", "x y", "q r s", "t u v", "t u v w"])
    assert (3, None) in kept and (3, "") in kept and len(kept) == len(rows)


def test_a_text_of_very_many_lines_and_a_very_long_word(spark):
    n = 1_200_000
    text = "\n".join(f"w{i}" for i in range(n)) + "\nw5\n\nw7"
    rows = [(1, text), (2, "y" * 5_000_000), (3, "y" * 5_000_000 + "\nw9"), (4, "z")]
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == "\n".join(f"w{i}" for i in range(n)) + "\n" and out[2] == rows[1][1] and out[3] == "" and out[4] == "z"


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and {got[i] for i in (200, 201, 202)} == {200}


def test_lines_of_one_text_beyond_the_bits_of_a_line_number(spark):
    """Lines i and i + 2**20 of one text are not one set."""
    import numpy as np
    import pyarrow as pa

    from docloom.llm import linededup
    from docloom.llm import textops as T

    [c] = T.chunks(pa.array([" \n\n", None]))
    assert not len(linededup._sets(c)[0])
    n = (1 << 20) + 3
    [c] = T.chunks(pa.array(["\n".join(f"w{i} z{i // 7}" for i in range(n))]))
    doc, number, bounds, _ = linededup._sets(c)
    assert len(doc) == n and (number == np.arange(n)).all() and (np.diff(bounds) == 2).all()
    got = linededup.line_sets(spark.createDataFrame([(1, "a b\n" + "\n" * (1 << 20) + "c d\n" + "a b")], "doc_id long, text string"), np.zeros(1 << linededup.FREQ_BITS, np.int32), 0.8).collect()
    assert sorted((r.line, r.n) for r in got) == [(0, 2), ((1 << 20) + 1, 2), ((1 << 20) + 2, 2)]
    alike = {r.line: (r.h1, r.h2, r.bitmap, r.stars, r.prefix) for r in got}
    assert alike[0] == alike[(1 << 20) + 2] != alike[(1 << 20) + 1]


def test_pairs_of_a_large_group_grow_with_its_lines(spark, monkeypatch):
    """Lines that are near copies of one text, after lines that share many of its words only: the pairs for the exact join are a few for each line."""
    from docloom.llm import linededup

    made, write = [], linededup.written

    def written(df, name):
        out = write(df, name)
        if name == "line-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(linededup, "written", written)
    base = [f"w{i}" for i in range(90)]

    def rows(n):
        rng = random.Random(n)
        half = [" ".join(w if rng.random() < 0.6 else f"h{i}q{j}" for j, w in enumerate(base)) for i in range(n // 10)]
        near = [" ".join(w if rng.random() < 0.97 else f"n{rng.randrange(40)}" for w in base) for _ in range(n)]
        return list(enumerate(half + near))

    for n in (120, 600):
        data = rows(n)
        got = op9_line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert {r.doc_id: r.removed for r in got if r.removed} == lines_brute(data)
    assert made[1] < 600 * 8


def test_bitmaps_of_long_lines():
    """The two halves bound the symmetric difference, and tell lines of 150 words apart."""
    from docloom.llm import linededup
    from docloom.llm import textops as T

    rng = np.random.default_rng(3)
    for n, left in ((150, 0), (150, 7), (200, 150), (100, 1)):
        x = np.unique(rng.integers(0, 1 << 50, n).astype(np.uint64))
        y = np.append(x[left:], rng.integers(0, 1 << 50, left).astype(np.uint64))
        at, size = np.array([0, len(x)]), np.array([len(x), len(y)])
        b, w = (v.view(np.uint64) for v in linededup._bitmaps(T.mix(np.append(x, y)), at, size))
        narrow, wide = int(b[0] ^ b[1]), int(w[0] ^ w[1])
        distance = wide.bit_count() + (narrow ^ wide).bit_count()
        assert narrow.bit_count() <= distance <= 2 * left and (left < 150 or distance > 2 * 200 / 9)
    assert linededup._bitmaps(T.mix(x[:95]), np.array([0]), np.array([95]))[1][0] == 0


def test_wanted_lines_are_cut_out_whole():
    """The word sets of lines cut out of a chunk are those that they have in it; empty lines have none."""
    import pyarrow as pa

    from docloom.llm import linededup
    from docloom.llm import textops as T

    [c] = T.chunks(pa.array(["a B c\n\n \nd é\td", "", None, "\n", "x", "y z\n"]))
    doc, start, end = T.lines(c)
    _, _, bounds, h = linededup._sets(c)
    whole = [h[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:], strict=False)]
    assert [len(x) for x in whole] == [3, 2, 1, 2]
    _, _, bounds, h = linededup._sets(linededup._cut_out(c, start, end))
    assert [h[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:], strict=False)] == whole
    some = linededup._cut_out(c, start[[0, 1]], end[[0, 1]])
    assert linededup._sets(some)[3].tolist() == whole[0] and some.buf.tobytes() == b"a B c"
    assert not len(linededup._sets(linededup._cut_out(c, start[1:2], end[1:2]))[3])


@pytest.mark.parametrize("hot", [1 << 14, 8])
def test_prefix_join_of_packed_postings(spark, monkeypatch, hot):
    """Every candidate under the filters and no other, also when a word's postings are cut into blocks that are dealt out anew."""
    from docloom.llm import linededup

    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "PAIRS", 50)
    rng, made, write = random.Random(5), [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name: made.append((name, write(df, name))) or made[-1][1])
    monkeypatch.setattr(linededup, "dropped", lambda *tables: None)
    rows = []
    for i in range(150):
        n = rng.choice([1, 2, 5, 9, 10, 11, 12, 30, 99, 110, 120])
        k = n - math.ceil(0.8 * n - 1e-9) + 1
        rows.append((i, n, rng.getrandbits(2), rng.getrandbits(2), int(rng.random() < 0.3), [rng.choice([0, -7, *range(1, 12)]) for _ in range(k)]))
    want = {}
    for a, n, p, v, _, xs in rows:
        for b, m, q, w, gone, ys in rows:
            most, common = (n + m) / 9 + 1e-9, 0.8 / 1.8 * (n + m) - 1e-9
            if a < b and not gone and n >= 0.8 * m - 1e-9 and m >= 0.8 * n - 1e-9 and (p ^ q).bit_count() <= most and (min(n, m) < 96 or (v ^ w).bit_count() + (p ^ q ^ v ^ w).bit_count() <= most):
                if any(x == y != 0 and n - i >= common and m - j >= common for i, x in enumerate(xs) for j, y in enumerate(ys)):
                    want[a, b] = (p ^ q).bit_count()
    lines = spark.createDataFrame(rows, "id long, n int, bitmap long, wide long, gone int, prefix array<int>")
    assert {(r.a, r.b): r.d for r in linededup._line_pairs(lines, 0.8).collect()} == want and len(want) > 500
    assert dict(made)["postings"].filter("x is not null").isEmpty() == (hot > 8)


def test_numbers_of_lines_and_copies(spark):
    """Line counts come with the line sets: a null text has no line, an empty one has one; every copy but the first goes, and all of a line that has matched."""
    base = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(base) + "\n"), (2, None), (3, ""), (4, "\n\n"), (5, " ".join(base[1:]) + "\nx"), (6, "x\n" + " ".join(base[1:])), (6, "x\n" + " ".join(base[1:]))]
    got = op9_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0, []), (2, 0, 0, []), (3, 1, 0, []), (4, 3, 0, []), (5, 2, 1, [0]), (6, 2, 2, [0, 1]), (6, 2, 2, [0, 1])]
