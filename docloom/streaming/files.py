"""Files extracted as they arrive.  Each file stands alone, so the stream needs neither state nor watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.contract import Limits, Options
from docloom.functions.text import logical_name
from docloom.operators.extract import Extraction, extract

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, options: Options | dict | None = None, limits: Limits | None = None, per_trigger: int = 100) -> DataFrame:
    """Streaming documents (as ``Extraction.documents``) of a folder's new files."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).load(folder)
    files = found.select(F.col("path").alias("doc_id"), logical_name(F.col("path")).alias("file_name"), "content")
    return extract(files, options, limits).documents


def write_tables(documents: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append parts, images and failures of each micro-batch to Parquet tables below ``folder``; stops when no files are left."""

    def save(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        made = Extraction(kept)
        for name in ("parts", "images", "failures"):
            getattr(made, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        kept.unpersist()

    return documents.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
