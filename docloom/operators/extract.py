"""Extraction of a table of files: parts, images, results and failures as DataFrames.

One Arrow pass reads the files; a document's budget is sequential, so a document
is the unit of work and documents spread over the cluster.  A document is one
row with its parts as an array: offsets, status and manifests are expressions
over that row, and no table of an extraction needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.contract import PARTIAL, SCHEMA_VERSION, VERSION, DocumentError, Limits, Options
from docloom.operators.tree import OcrEngine, Tree, extract_bytes

WARNING = "array<struct<code:string,detail:string>>"
PART = f"struct<index:int,parent_index:int,path:string,depth:int,kind:string,mime:string,size_bytes:bigint,pages:int,engine:string,duration_ms:bigint,markdown:string,markdown_file:string,truncated:boolean,warnings:{WARNING},image_ids:array<string>,char_start:int,char_end:int>"
IMAGE = "struct<id:string,part_index:int,file:string,mime:string,width:int,height:int,size_bytes:bigint,ocr_chars:int,bytes:binary>"
ROW = f"doc_id string, exit_code int, error_code string, output_truncated boolean, parts array<{PART}>, images array<{IMAGE}>"


#: Rows and bytes of contents after which a batch of results is passed on.
ROWS, BYTES = 512, 4 << 20


def _row(doc_id: str, tree: Tree) -> dict:
    ends = pairwise(accumulate((len(p.markdown.encode("utf-16-le", "surrogatepass")) // 2 for p in tree.parts), initial=0))
    parts = [
        {
            "index": p.index, "parent_index": p.parent, "path": p.path, "depth": p.depth, "kind": p.kind, "mime": p.mime, "size_bytes": p.size, "pages": p.pages, "engine": p.engine,
            "duration_ms": p.duration_ms, "markdown": p.markdown, "markdown_file": f"parts/{p.index}.md", "truncated": p.truncated,
            "warnings": [{"code": c, "detail": d} for c, d in p.warnings.items()], "image_ids": p.images, "char_start": start, "char_end": end,
        }
        for p, (start, end) in zip(tree.parts, ends, strict=True)
    ]
    images = [
        {"id": i.id, "part_index": i.part, "file": f"images/{i.id}{i.extension}", "mime": i.mime, "width": i.width, "height": i.height, "size_bytes": len(i.data), "ocr_chars": i.ocr_chars, "bytes": i.data}
        for i in tree.images
    ]
    return {"doc_id": doc_id, "exit_code": 0, "error_code": None, "output_truncated": tree.cut, "parts": parts, "images": images}


@dataclass
class Extraction:
    """Lazy tables of one extraction; ``documents`` has a row for each file."""

    documents: DataFrame

    @property
    def failures(self) -> DataFrame:
        return self.documents.filter("exit_code <> 0").select("doc_id", "exit_code", "error_code")

    @property
    def parts(self) -> DataFrame:
        """A row for each part, with its offsets in UTF-16 units."""
        return self.documents.filter("exit_code = 0").select("doc_id", F.inline("parts"))

    @property
    def images(self) -> DataFrame:
        return self.documents.filter("exit_code = 0").select("doc_id", F.inline("images"))

    @property
    def results(self) -> DataFrame:
        """A row for each extracted file: header, parts and images as arrays, without their contents."""
        return self.documents.filter("exit_code = 0").select("doc_id", *result_columns())


def result_columns() -> list[Column]:
    """Header, parts and images of a row of ``documents``."""
    part = F.col("parts")
    cut = F.col("output_truncated") | F.exists(part, lambda p: p["truncated"])
    partial = F.exists(part, lambda p: F.exists(p["warnings"], lambda w: w["code"].isin(*PARTIAL)))
    return [
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(VERSION).alias("extractor_version"), F.when(cut | partial, "partial").otherwise("ok").alias("status"),
        F.array_max(F.transform(part, lambda p: p["char_end"])).alias("total_chars"), cut.alias("truncated"),
        F.transform(part, lambda p: p.dropFields("markdown")).alias("parts"), F.transform("images", lambda i: i.dropFields("bytes")).alias("images"),
    ]


def extract(files: DataFrame, options: Options | dict | None = None, limits: Limits | None = None, ocr: OcrEngine | None = None) -> Extraction:
    """Extract ``files`` (doc_id, file_name, content): what can't be read is a row of ``failures``, never a failed job."""
    options = Options.of(options)
    limits = (limits or Limits()).with_options(options) if limits is None else limits
    schema = files.sparkSession.createDataFrame([], ROW).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def one(doc_id: str, name: str, content: bytes) -> dict:
        try:
            return _row(doc_id, extract_bytes(content or b"", name or "document", options, limits, ocr))
        except DocumentError as e:
            code = e.exit_code, e.error_code
        except Exception:
            code = 1, "E_FAILED"
        return {"doc_id": doc_id, "exit_code": code[0], "error_code": code[1], "output_truncated": False, "parts": [], "images": []}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            ids, names, contents = b.columns
            for i in range(len(ids)):
                rows.append(one(ids[i].as_py(), names[i].as_py(), contents[i].as_py()))
                size += sum(p["char_end"] - p["char_start"] for p in rows[-1]["parts"]) + sum(x["size_bytes"] for x in rows[-1]["images"])
                if len(rows) >= ROWS or size >= BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    slim = files.select(F.col("doc_id").cast("string"), F.col("file_name").cast("string"), "content")
    return Extraction(slim.mapInArrow(read, schema))
