"""Queries that put documents into files and extract them: archives, mail, office documents, text."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.raw import decode, image_size, sniff
from docloom.operators.extract import extract
from docloom.sources.files import manifest, parse_manifest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def _rels(kind: str, target: str) -> str:
    return f'<Relationships><Relationship Id="r1" Type="{R}/{kind}" Target="{target}"/></Relationships>'


def _docx(text: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
    return _zip({"[Content_Types].xml": "<Types/>", "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'})


def _xlsx(text: str) -> bytes:
    rows = "".join(f'<row><c t="inlineStr"><is><t>{escape(x)}</t></is></c></row>' for x in text.split("\n"))
    return _zip({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _rels("worksheet", "s.xml"), "xl/s.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>"})


def _pptx(text: str) -> bytes:
    body = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in text.split("\n"))
    return _zip({"ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": _rels("slide", "s.xml"), "ppt/s.xml": f"<p:sld {P}>{body}</p:sld>"})


def _eml(text: str) -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@example.com", "b@example.com", "s"
    m.set_content("body")
    m.add_attachment(text.encode(), "text", "plain", filename="note.txt")
    return m.as_bytes()


MAKERS: dict[str, tuple[str, Callable[[str], bytes]]] = {
    "text": ("d.txt", lambda t: t.encode()), "zip": ("d.zip", lambda t: _zip({"inner.txt": t, "deep/x.md": "x"})), "docx": ("d.docx", _docx), "xlsx": ("d.xlsx", _xlsx), "pptx": ("d.pptx", _pptx), "eml": ("d.eml", _eml),
}


def packed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Every document as a file of the kind: doc_id, file_name, content."""
    name, make = MAKERS[kind]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [make(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(files)), pa.array(files, pa.binary())], ["doc_id", "file_name", "content"])

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string"), "text")
    docs = docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")  # as files would be: a table may be one row group
    return docs.mapInArrow(build, "doc_id string, file_name string, content binary")


def _extracted(kind: str, index: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts = extract(packed(spark, sf, kind)).parts.filter(F.col("index") == index)
        return parts.select("doc_id", "path", "kind", "markdown", "char_start", "char_end")

    return run


WS = r"[\s\x{00A0}\x{0085}]+"
TRIMMED = rf"regexp_replace(regexp_replace(text, '^{WS}', ''), '{WS}$', '')"


def _sql(path: str, start: str | None = "0") -> str:
    md = f"'## {path}' || chr(10) || chr(10) || {TRIMMED} || chr(10)"
    return f"SELECT doc_id::VARCHAR AS doc_id, '{path}' AS path, 'text' AS kind, {md} AS markdown, ({start})::INT AS char_start, ({start} + length({md}))::INT AS char_end FROM documents"


def _lines(line: str, kept: str = "true") -> str:
    """SQL of the text's lines, each made by ``line`` of its trimmed ``x``, where ``kept`` holds."""
    trimmed = rf"regexp_replace(regexp_replace(x, '^{WS}', ''), '{WS}$', '')"
    return f"array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trimmed}), lambda x: {kept}), lambda x: {line}), '')"


def _office(path: str, kind: str, body: str) -> str:
    return f"WITH t AS (SELECT doc_id, '## {path}' || chr(10) || chr(10) || {body} AS markdown FROM documents) SELECT doc_id::VARCHAR AS doc_id, '{path}' AS path, '{kind}' AS kind, markdown, 0::INT AS char_start, length(markdown)::INT AS char_end FROM t"


PARAGRAPHS = _lines("x || chr(10) || chr(10)", "x <> ''")
CELLS = _lines("'| ' || replace(x, '|', '\\|') || ' |' || chr(10)")
#: The rule stands below the first row.
SHEET = f"'### Sheet: S' || chr(10) || chr(10) || regexp_replace({CELLS}, '^([^\n]*\n)', '\\1| --- |' || chr(10)) || chr(10)"
#: Length of the mail's own part.
MAIL = "length('## d.eml' || '**From:** a@example.com' || '**To:** b@example.com' || '**Subject:** s' || 'body' || 'Attachments:' || '- note.txt') + 14"


def extract_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of mails with attachments."""
    return manifest(extract(packed(spark, sf, "eml")).results)


def read_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The same manifests, read again: header and the attachment's entry."""
    found = parse_manifest(extract_manifest(spark, sf))
    part = F.col("parts")[1]
    return found.select("doc_id", "schemaVersion", "extractorVersion", "status", "totalChars", "truncated", F.size("parts").alias("n_parts"), part["path"].alias("path"), part["kind"].alias("kind"), part["depth"].alias("depth"), part["sizeBytes"].alias("sizeBytes"), part["charStart"].alias("charStart"), part["charEnd"].alias("charEnd"), part["markdownFile"].alias("markdownFile"), "error")


def decode_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as UTF-8, UTF-16 with a mark and without, and windows-1252, decoded by look."""
    i, text = F.col("doc_id") % 5, F.col("text")
    mark = lambda h, code: F.concat(F.unhex(F.lit(h)), F.encode(text, code))
    data = F.when(i == 0, F.encode(text, "UTF-8")).when(i == 1, mark("EFBBBF", "UTF-8")).when(i == 2, mark("FFFE", "UTF-16LE")).when(i == 3, mark("FEFF", "UTF-16BE")).otherwise(F.unhex(F.lit("E9742080")))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", data.alias("data"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or b"") for x in b.column(1).to_pylist()])], ["doc_id", "text"])

    return rows.mapInArrow(read, "doc_id long, text string")


def image_header(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of PNG, GIF, BMP and JPEG images, made of parts' numbers: type and pixel size."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w, h = key % 60_000 + 1, size
                data = [
                    b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h), b"GIF89a" + struct.pack("<HH", w, h),
                    b"BM" + bytes(16) + struct.pack("<ii", w, -h), b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", h, w),
                ][key % 4]
                kind, mime = sniff(data, "x.bin")
                rows.append((key, kind, mime, *image_size(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["p_partkey", "kind", "mime", "width", "height"])

    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("long"), F.col("p_size").cast("int"))
    return parts.mapInArrow(made, "p_partkey long, kind string, mime string, width int, height int")


def extract_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status and size of every archive under a small output cap."""
    return extract(packed(spark, sf, "zip"), {"max_output_chars": 500}).results.select("doc_id", "status", "total_chars", "truncated")


TOKEN = "SELF-TEST-TOKEN"
#: Name, file name, content and the kind of the part that must hold the token; without a kind the file must be refused.
FIXTURES: list[tuple[str, str, Callable[[], bytes], str | None]] = [
    *((k, name, lambda make=make: make(TOKEN), {"zip": "text", "eml": "text"}.get(k, k)) for k, (name, make) in MAKERS.items()),
    ("html", "d.html", lambda: f"<html><body><p>{TOKEN}</p></body></html>".encode(), "text"),
    ("rtf", "d.rtf", lambda: f"{{\\rtf1 {TOKEN}}}".encode(), "text"),
    ("unsupported", "d.bin", lambda: bytes(range(256)), None),
]


def self_test(spark: SparkSession, sf: str = "") -> DataFrame:
    """A row for each fixture: whether it is read as it should be, and the error code of one that is refused."""
    made = spark.createDataFrame([(name, file, bytearray(make())) for name, file, make, _ in FIXTURES], "doc_id string, file_name string, content binary")
    kinds = spark.createDataFrame([(name, kind) for name, _, _, kind in FIXTURES], "doc_id string, expected string")
    found = extract(made).documents
    held = F.exists("parts", lambda p: (p["kind"] == F.col("expected")) & F.contains(p["markdown"], F.lit(TOKEN)))
    passed = F.when(F.col("expected").isNull(), F.col("exit_code") != 0).otherwise(held)
    return found.join(kinds, "doc_id").select(F.col("doc_id").alias("name"), passed.alias("passed"), "error_code")


LISTING = "length('## d.zip' || 'Entries:' || '- `inner.txt` (' || octet_length(encode(text)) || ' bytes)' || '- `deep/x.md` (1 bytes)') + 7"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "text_extract": _extracted("text", 0), "zip_tree": _extracted("zip", 1), "eml_tree": _extracted("eml", 1),
    "docx_extract": _extracted("docx", 0), "xlsx_extract": _extracted("xlsx", 0), "pptx_extract": _extracted("pptx", 0), "manifest_json": extract_manifest, "extract_status": extract_status,
    "parse_manifest": read_manifest, "decode_bytes": decode_bytes, "image_header": image_header, "self_test": self_test,
}
TOTAL = f"(({LISTING}) + length('## d.zip/inner.txt') + 2 + length({TRIMMED}) + 1 + length('## d.zip/deep/x.md') + 2 + 2)"
SQL: dict[str, str] = {
    "text_extract": _sql("d.txt"), "zip_tree": _sql("d.zip/inner.txt", LISTING), "eml_tree": _sql("d.eml/note.txt", MAIL),
    "docx_extract": _office("d.docx", "docx", PARAGRAPHS), "xlsx_extract": _office("d.xlsx", "xlsx", SHEET), "pptx_extract": _office("d.pptx", "pptx", f"'### Slide 1' || chr(10) || chr(10) || {PARAGRAPHS}"),
    "parse_manifest": f"""WITH t AS (SELECT doc_id, text, ({MAIL})::INT AS s, (({MAIL}) + length('## d.eml/note.txt') + 3 + length({TRIMMED}))::INT AS e FROM documents)
SELECT doc_id::VARCHAR AS doc_id, 1::INT AS "schemaVersion", '1.0.0' AS "extractorVersion", 'ok' AS status, e AS "totalChars", false AS truncated, 2::INT AS n_parts, 'd.eml/note.txt' AS path, 'text' AS kind, 1::INT AS depth, octet_length(encode(text))::BIGINT AS "sizeBytes", s AS "charStart", e AS "charEnd", 'parts/1.md' AS "markdownFile", NULL::VARCHAR AS error FROM t""",
    "self_test": "SELECT * FROM (VALUES " + ", ".join(f"('{name}', true, {'NULL' if kind else chr(39) + 'E_UNSUPPORTED' + chr(39)})" for name, _, _, kind in FIXTURES) + ") t(name, passed, error_code)",
    "decode_bytes": "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'ét €' ELSE coalesce(text, '') END AS text FROM documents",
    "image_header": "SELECT p_partkey::BIGINT AS p_partkey, 'image' AS kind, ['image/png', 'image/gif', 'image/bmp', 'image/jpeg'][(p_partkey % 4 + 1)::INT] AS mime, (p_partkey % 60000 + 1)::INT AS width, p_size::INT AS height FROM part",
    "extract_status": f"SELECT doc_id::VARCHAR AS doc_id, CASE WHEN {TOTAL} > 500 THEN 'partial' ELSE 'ok' END AS status, least(500, {TOTAL})::INT AS total_chars, {TOTAL} > 500 AS truncated FROM documents",
}
