import json
import os

import pytest

from docloom.contract import CorruptFile, DocumentError, ExtractionFailed
from docloom.functions import raw
from docloom.functions import text as X
from docloom.operators import ordered
from docloom.operators.extract import extract
from docloom.plans import catalog
from docloom.sources.files import manifest, parse_manifest, read_document, read_files, write_documents
from docloom.streaming.files import stream_files, write_tables
from pyspark.sql import functions as F
from tests import fixtures as Z
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert difference(df, db, catalog.SQL[name]) is None
    else:
        assert df.count() == 200


FILES = {"a.txt": b"hello \xf0\x9f\x98\x80", "m.eml": Z.eml(("n.txt", b"inside", "text/plain"), ("p.png", Z.png(), "image/png")), "z.zip": Z.zipped({"x.docx": Z.docx(), "bad.bin": b"\x01\x02"}), "t.pdf": b"%PDF-1.4 trunc", "u": b"\x01\x02\x03"}


def test_folder_to_tables_and_back(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    for i, (name, data) in enumerate(FILES.items()):
        (src / ("sub" if i % 2 else "") / name).write_bytes(data)
    (src / "big.bin").write_bytes(b"x" * 2_000_000)
    from docloom.contract import Limits

    files, large = read_files(spark, str(src), Limits(input_bytes=1_000_000))
    assert [r.error_code for r in large.collect()] == ["E_LIMIT_INPUT_SIZE"] and "LessThanOrEqual(length,1000000)" in files._jdf.queryExecution().toString()
    out = extract(files)
    leaf = lambda r: r.doc_id.rsplit("/", 1)[-1]
    assert {leaf(r): r.error_code for r in out.failures.collect()} == {"t.pdf": "E_CORRUPT", "u": "E_UNSUPPORTED"}
    empty = spark.createDataFrame([("e", "e.txt", b""), ("n", None, None)], "doc_id string, file_name string, content binary")
    assert {r.error_code for r in extract(empty).failures.collect()} == {"E_CORRUPT"}
    parts = sorted(out.parts.collect(), key=lambda r: (leaf(r), r["index"]))
    assert [(leaf(r), r["index"], r.parent_index, r.kind) for r in parts] == [("a.txt", 0, None, "text"), ("m.eml", 0, None, "eml"), ("m.eml", 1, 0, "text"), ("z.zip", 0, None, "zip"), ("z.zip", 1, 0, "docx"), ("z.zip", 2, 0, "unsupported")]
    for a, b in zip(parts, parts[1:], strict=False):
        assert a.char_end - a.char_start == raw.units(a.markdown) and b.char_start == (a.char_end if a.doc_id == b.doc_id else 0)
    results = {leaf(r): r for r in out.results.collect()}
    assert {k: r.status for k, r in results.items()} == {"a.txt": "ok", "m.eml": "partial", "z.zip": "partial"}
    assert results["m.eml"].images[0].part_index == 0 and [p["index"] for p in results["z.zip"].parts] == [0, 1, 2]
    text = manifest(out.results)
    back = {leaf(r): r for r in parse_manifest(text).collect()}
    assert back["z.zip"].error is None and back["z.zip"].parts[1].path == "z.zip/x.docx" and '"pages" : null' in text.filter("doc_id like '%a.txt'").first().json
    write_documents(out, str(tmp_path / "out"))
    folders = sorted(os.listdir(tmp_path / "out"))
    assert len(folders) == 3
    for f in folders:
        d = read_document(str(tmp_path / "out" / f))
        assert "".join(p["markdown"] for p in d["parts"]) and all(i["bytes"] for i in d["images"])
    bad = tmp_path / "out" / folders[0] / "result.json"
    d = json.loads(bad.read_text())
    d["parts"][0]["markdownFile"] = "../secret.md"
    bad.write_text(json.dumps(d))
    with pytest.raises(DocumentError, match="E_UNSAFE_PATH"):
        read_document(str(bad.parent))
    bad.write_text("{")
    with pytest.raises(CorruptFile):
        read_document(str(bad.parent))
    rows = spark.createDataFrame([("1", json.dumps(d)), ("2", "{"), ("3", '{"parts": []}')], "doc_id string, json string")
    assert {r.doc_id: (r.error, r.status) for r in parse_manifest(rows).collect()} == {"1": ("E_UNSAFE_PATH", d["status"]), "2": ("E_CORRUPT", "ok"), "3": (None, "ok")}


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a.txt", "z.zip", "u"):
        (src / name).write_bytes(FILES[name])
    write_tables(stream_files(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    (src / "m.eml").write_bytes(FILES["m.eml"])
    write_tables(stream_files(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t" / "parts")).count() == 6 and spark.read.parquet(str(tmp_path / "t" / "failures")).count() == 1


def test_slices_and_budget_with_surrogates(spark):
    rows = spark.createDataFrame([(1, 0, "Hello 😀"), (1, 1, "Tail"), (None, 0, "😀😀")], "d long, i long, t string")
    page = lambda a, b: {r.d: r.page for r in ordered.page_slice(rows, ["d"], "i", "t", a, b).collect()}
    assert page(0, 5)[1] == "Hello" and page(6, 8)[1] == "😀" and page(6, 7)[1] == "" and page(7, 12)[1] == "Tail" and page(50, 60)[1] == ""
    with pytest.raises(ExtractionFailed):
        page(3, 2)
    for cap in range(13):
        got = {(r.d, r.i): (r.taken, r.kept) for r in ordered.output_budget(rows, ["d"], "i", "t", cap).collect()}
        left = cap
        for i, t in enumerate(("Hello 😀", "Tail")):
            kept = raw.cut_units(t, left)
            assert got[1, i] == (raw.units(kept), kept)
            left -= raw.units(kept)


def test_expressions_equal_plain_functions(spark):
    texts = ["a\n \n \nb", "  x\t\ty \r\n\r\n\r\n z ", "<p>a</p><script>x</script>b&amp;lt;&amp", "<style>q", "", "nul|pipe\nx", "{\\rtf1\\b bold\\fs24 x}", "con.txt", "a/../b", "LPT1 .x", "/lead", "x:y", "..", "é  z", "AUX"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", X.white_space(F.col("t")).alias("ws"), X.html_to_text(F.col("t")).alias("html"), X.md_cell(F.col("t")).alias("cell"), X.rtf_strip(F.col("t")).alias("rtf"), X.reserved_name(F.col("t")).alias("res"),
        X.unsafe_path(F.col("t")).alias("unsafe"), X.safe_name(F.col("t"), "f").alias("safe"), X.heading(F.col("t")).alias("head"), X.extension(F.col("t")).alias("ext"), X.utf16_truncate(F.col("t"), F.lit(3)).alias("cut"),
    )
    for r in got.collect():
        want = (raw.white_space(r.t), raw.html_to_text(r.t), raw.md_cell(r.t), raw.rtf_strip(r.t), raw.reserved(r.t), raw.unsafe(r.t), raw.safe_name(r.t, "f"), raw.heading(r.t), raw.extension(r.t), raw.cut_units(r.t, 3))
        assert tuple(r)[1:] == want
