import corpus_pipeline
from docloom.llm import components, linededup, parityjoin, perplexity, shared
from docloom.llm.decontam import contaminated
from docloom.llm.packing import lengths_of
from tests.llm.helpers import corpus, shingles
from tests.llm.test_joins import lines_brute
from tests.llm.test_perplexity import base


def test_stages_over_a_small_corpus(spark, tmp_path):
    """Each stage against what it should leave of its input; packing holds every piece of what is left."""
    rows = [r for r in corpus(90, 11)[:-1]]
    item = "a passage of the benchmark that no clean document holds at all"
    rows += [(2000, "\n".join([rows[0][1] or "", item, " ".join(f"w{i}" for i in range(60))]), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{name}")
        before, after = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(f"{tmp_path}/{name}")
        rows_after = {r.doc_id: r for r in after.collect()}
        if name == "quality":
            for i, r in before.items():
                n, _, _, _, repeated = base(r.text)
                assert i not in rows_after or n >= 10 and 100 * repeated <= 20 * n
            assert len(rows_after) > len(before) / 3
        if name == "line_dedup":
            gone = lines_brute([(r.doc_id, r.text) for r in before.values()])
            for i, r in before.items():
                left = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(i, []))
                assert (rows_after[i].text if i in rows_after else "") == left
        if name == "near_duplicates":
            sets = {i: shingles(r.text, 5) for i, r in rows_after.items()}
            assert all(5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j]) or not sets[i] for i in sets for j in sets if i < j)
        if name == "decontamination":
            assert 2000 not in rows_after and contaminated(after, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
        if name == "packing":
            total = {r.doc_id: r.length for r in lengths_of(docs).collect()}
            got = {}
            for r in after.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == total
        docs = after


def test_copies_with_blank_lines_leave_nothing(spark):
    rows = [(1, "one two three\n\nfour five six\n\n", 0), (2, "one two three\n\nfour five six\n\n", 0), (3, " \n\n", 0), (4, None, 0), (5, "one two three\n\nseven eight", 0)]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    assert out.columns == ["doc_id", "text", "n_chars"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 3: " \n\n", 4: None, 5: "\nseven eight"}


def test_small_sides_are_not_broadcast(spark, monkeypatch):
    """No stage before decontamination collects a side of a join in the driver for its intermediate tables, however small it is."""
    plans, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for module in (components, linededup, parityjoin, perplexity):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, real=real: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    docs = spark.createDataFrame([r for r in corpus(40, 3)[:-1]], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        plans.clear()
        stage(spark, docs, "")
        assert any("SortMergeJoin" in x for x in plans) and not any("BroadcastHashJoin" in x for x in plans), name
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_driver_returns_what_it_has_freed(spark, monkeypatch):
    """Every intermediate table gives the freed native memory of the driver's JVM back, and the JVM says so."""
    said, real = [], shared.trimmed
    monkeypatch.setattr(shared, "trimmed", lambda session: said.append(real(session)))
    docs = spark.createDataFrame([(i, f"some words of a text {i}") for i in range(4)], "doc_id long, text string")
    shared.dropped(shared.written(docs, "a"), shared.written(docs, "b"))
    assert len(said) == 2 and all("Trim native heap" in x for x in said)


def test_rounds_without_pairs_join_nothing(spark, monkeypatch):
    """Texts that share no shingle make no candidates, so that no round joins their sets; links that are there are found as before."""
    names, real = [], parityjoin.written
    monkeypatch.setattr(parityjoin, "written", lambda df, name: names.append(name) or real(df, name))
    apart = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(6)]
    docs = spark.createDataFrame(apart, "doc_id long, text string")
    assert sorted(r.doc_id for r in parityjoin.near_duplicate_stage(docs).collect()) == [0, 1, 2, 3, 4, 5] and "links" not in names
    names.clear()
    docs = spark.createDataFrame([*apart, (6, apart[2][1] + " more")], "doc_id long, text string")
    assert sorted(r.doc_id for r in parityjoin.near_duplicate_stage(docs).collect()) == [0, 1, 2, 3, 4, 5]
    assert names.count("links") == 1
