"""Reading files and writing results."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.contract import CorruptFile, Limits, error_for
from docloom.functions import raw
from docloom.functions.text import logical_name, unsafe_path
from docloom.operators.extract import result_columns


def read_files(spark: SparkSession, path: str, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, failures) of a folder or glob: too large files are failures, and the scan never reads them.

    Spark's binaryFile source doesn't list empty files.
    """
    most = (limits or Limits()).input_bytes
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = found.filter(F.col("length") <= most).select(F.col("path").alias("doc_id"), logical_name(F.col("path")).alias("file_name"), "length", "content")
    large = found.filter(F.col("length") > most).select(F.col("path").alias("doc_id"), F.lit(3).alias("exit_code"), F.lit("E_LIMIT_INPUT_SIZE").alias("error_code"))
    return files, large


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def manifest(results: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carried`` columns and the document's manifest as JSON: camel-case names, nulls written."""

    def renamed(kind, c: Column) -> Column:  # noqa: ANN001
        if kind.typeName() == "struct":
            return F.struct(*[renamed(f.dataType, c[f.name]).alias(camel(f.name)) for f in kind.fields if f.name != "parent_index"])
        return F.transform(c, lambda x: renamed(kind.elementType, x)) if kind.typeName() == "array" else c

    body = F.struct(*[renamed(f.dataType, F.col(f.name)).alias(camel(f.name)) for f in results.schema if f.name not in ("doc_id", *carried)])
    return results.select("doc_id", *carried, F.to_json(body, {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


MANIFEST = (
    "schemaVersion int, extractorVersion string, status string, totalChars int, truncated boolean, parts array<struct<index:int,path:string,depth:int,kind:string,mime:string,sizeBytes:bigint,pages:int,engine:string,"
    "durationMs:bigint,charStart:int,charEnd:int,markdownFile:string,truncated:boolean,warnings:array<struct<code:string,detail:string>>,imageIds:array<string>>>, "
    "images array<struct<id:string,partIndex:int,file:string,mime:string,width:int,height:int,sizeBytes:bigint,ocrChars:int>>"
)


def parse_manifest(rows: DataFrame, column: str = "json") -> DataFrame:
    """Manifests as columns, with defaults for missing keys; ``error`` is E_UNSAFE_PATH or E_CORRUPT where one can't be used."""
    m = F.from_json(column, MANIFEST)
    out = rows.select("doc_id", m.alias("m"), F.try_parse_json(column).isNull().alias("_bad"))
    paths = F.concat(F.coalesce(F.transform("m.parts", lambda p: p["markdownFile"]), F.array()), F.coalesce(F.transform("m.images", lambda i: i["file"]), F.array()))
    error = F.when(F.col("_bad") | F.col("m").isNull() | F.col("m.parts").isNull(), "E_CORRUPT").when(F.exists(paths, unsafe_path), "E_UNSAFE_PATH")
    fields = {"schemaVersion": 1, "extractorVersion": "", "status": "ok", "totalChars": 0, "truncated": False}
    return out.select("doc_id", *[F.coalesce(f"m.{k}", F.lit(v)).alias(k) for k, v in fields.items()], F.coalesce("m.parts", F.from_json(F.lit("[]"), MANIFEST.split("parts ")[1].split(", images")[0])).alias("parts"), "m.images", error.alias("error"))


def document_folder(folder: str, doc_id: str) -> str:
    """A document's folder: its name, and a hash of the whole doc_id, as files of one name lie in many places."""
    return os.path.join(folder, f"{raw.safe_name(doc_id, 'document')}-{hashlib.sha256(doc_id.encode()).hexdigest()[:32]}")


def write_documents(extraction, folder: str) -> None:  # noqa: ANN001
    """A folder for each document (:func:`document_folder`): parts/<n>.md, images/<id>, and result.json last.

    ``folder`` must be a mounted file system that all executors share.  Every
    file is read once: the manifest is an expression over the document's row.
    """
    if "://" in folder:
        raise ValueError("write_documents takes a mounted path; write parts and manifest(results) with Spark's writers elsewhere")
    rows = extraction.documents.filter("exit_code = 0").select("doc_id", F.col("parts").alias("_parts"), F.col("images").alias("_images"), *result_columns())
    whole = manifest(rows, ("_parts", "_images")).select("doc_id", F.col("_parts").alias("parts"), F.col("_images").alias("images"), "json")

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            top = document_folder(folder, r.doc_id)
            files = [(p.markdown_file, p.markdown.encode()) for p in r.parts] + [(i.file, bytes(i.bytes)) for i in r.images] + [("result.json", r.json.encode())]
            for name, data in files:
                if raw.unsafe(name):
                    raise error_for("E_UNSAFE_PATH")
                os.makedirs(os.path.dirname(os.path.join(top, name)), exist_ok=True)
                with open(os.path.join(top, name), "wb") as f:
                    f.write(data)

    whole.foreachPartition(write)


def read_document(folder: str) -> dict:
    """A written document: its manifest with every part's text and image's bytes, after a check of every path."""
    try:
        with open(os.path.join(folder, "result.json"), encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError) as e:
        raise CorruptFile("E_CORRUPT") from e
    for part in found.get("parts", []):
        part["markdown"] = _inside(folder, part["markdownFile"]).decode()
    for image in found.get("images", []):
        image["bytes"] = _inside(folder, image["file"])
    return found


def _inside(folder: str, name: str) -> bytes:
    top, path = os.path.realpath(folder), os.path.realpath(os.path.join(folder, name))
    if raw.unsafe(name) or os.path.commonpath([top, path]) != top:
        raise error_for("E_UNSAFE_PATH")
    with open(path, "rb") as f:
        return f.read()
