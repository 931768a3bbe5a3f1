import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import huffman as H
from docloom.llm import textops as T
from tests.llm.helpers import SCHEMA, corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def odd_texts(n=400, seed=1):
    rng = random.Random(seed)
    parts = ["the", "Über", "don't", "  ", " ", "\n", "\n\n", "\t", " ", "é", "中文", "12", "3.5", "!!", "<|endoftext|>", "　", "\x1c", "\x85", "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_pieces_give_the_ids_of_whole_texts():
    texts = odd_texts()
    encoder = H.Encoder(PATH)
    got = []
    for c in T.chunks(pa.array(texts), 300):
        ids, bounds = encoder(c)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [x[:-1] for x in whole(texts)]


def test_round_trip(spark):
    rows = [r for r in corpus(80, 2)]
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd_texts(200, 5))]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(H.op10_huffman_ids(docs, PATH).collect(), key=lambda r: r.start)
    rows.sort(key=lambda r: r[0])
    at = 0
    for r, ids in zip(got, whole([r[1] for r in rows]), strict=True):
        assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert [r.doc_id for r in got] == [r[0] for r in rows]


def test_read_gives_ids(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b c", 1), (1, "hello there", 2), (None, None, 3)], "doc_id long, text string, ids int")
    H.write_ids(docs, str(tmp_path / "f"), PATH)
    got = {r.doc_id: r.ids for r in H.read_ids(spark, str(tmp_path / "f")).collect()}
    assert got == dict(zip([2, 1, None], whole(["b c", "hello there", None]), strict=True))


def test_empty(spark):
    assert H.op10_huffman_ids(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("limit", [4, 6, 30])
def test_code_lengths(limit):
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 0, 55, 89])
    got = H.code_lengths(counts, limit)
    used = counts > 0
    assert (got[used] > 0).all() and not got[~used].any() and got.max() <= limit
    assert abs(sum(2.0 ** -int(x) for x in got[used]) - 1) < 1e-12
    if limit == 30:
        heap = [(int(c), [i]) for i, c in enumerate(counts) if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
        assert (counts * got).sum() == cost


def test_bits():
    rng = np.random.default_rng(1)
    for n in (1, 2, 127, 128, 129, 5000):
        ids = np.minimum(rng.geometric(0.05, n), 300)
        lengths = H.code_lengths(np.bincount(ids, minlength=301))
        payload, checkpoints = H.pack(ids, lengths, H.canonical(lengths))
        assert (H.Decoder(lengths)(payload, checkpoints, n) == ids).all()


def test_registered_query_gives_the_plain_call(spark, tmp_path):
    """Ids of the library's default, also where a text holds the special token's string."""
    from docloom.llm import queries

    texts = [*odd_texts(200, 8), "<|endoftext|>", "a <|endoftext|> b", "<|endoftext", "|>", "x <|endoftext|><|endoftext|>\n", None, ""]
    t = Tokenizer.from_file(PATH)
    plain = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    encoder, got = H.Encoder(PATH, literal=False), []
    for c in T.chunks(pa.array(texts), 100):
        ids, bounds = encoder(c)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == plain and any(50256 in x for x in plain)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = 0
    for r in sorted(queries.q10(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = [*plain[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_tasks_count_their_own_ids(spark):
    """Counts come with the ids, so that no id is read again for them; the tasks' rows are no documents."""
    texts = odd_texts(60, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = H.tokenised(docs, PATH, 2)
    size = Tokenizer.from_file(PATH).get_vocab_size()
    want = np.bincount([i for x in whole(texts) for i in x], minlength=size)
    assert tokens.filter("counts is not null and ids is null and doc_id is null").count() == tokens.filter("counts is not null").count() > 0
    assert tokens.filter("ids is not null").count() == len(texts)
    assert (H.id_counts(tokens.select("counts"), size) == want).all()


def test_pieces_encoded_in_a_row_have_the_ids_of_whole_texts():
    """Pieces from a blank and a visible character to one are encoded in rows; cut apart by the tokens' lengths they are what the library makes of whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["It's 12ab3 (x)  y, don't 'tis a-b ... naïve é1 x y 中 a中 9", " a  b \n c\n\nd \t e", "#1 $2,000.50 %s {k: 'v'} 'll 're", "́x ́ z", " ", "", None, "q" * 300 + " " + "7" * 300]
    texts += [f" n{i}! v{i * 7}.{i} 'S{i}é Wörter{i}" for i in range(700)]
    [c] = T.chunks(pa.array(texts))
    encoder, plain = H.Encoder(path, literal=False), Tokenizer.from_file(path)
    calls = []

    class Counted:
        def encode_batch_fast(self, x, **how):
            calls.append(len(x))
            return plain.encode_batch_fast(x, **how)

        def encode_batch(self, x, **how):
            calls.append(len(x))
            return plain.encode_batch(x, **how)

    encoder.tokenizer = Counted()
    ids, bounds = encoder(c)
    for i, x in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(x or "", add_special_tokens=False).ids
    # 700 texts of four pieces
    assert sum(calls) < 1000
