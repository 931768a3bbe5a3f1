"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), reads what the stage before it wrote,
and works on all of it.  All but the last return the columns of ``documents``;
the last returns the bins' contents.

Cases: a null or empty text fails the quality rules and goes; a null doc_id is
an id like others; rows that share a doc_id are judged each by its own text,
and of rows equal in doc_id and text one stays; very long texts are judged
whole; extra columns are passed on by all stages but the last, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontam import decontamination_stage
from docloom.llm.linededup import dedup_lines
from docloom.llm.packing import op3_best_fit
from docloom.llm.parityjoin import near_duplicate_stage
from docloom.llm.perplexity import quality_stage
from docloom.llm.shared import MERGED, settings, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    with settings(spark, MERGED):
        return quality_stage(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; a document that has lost all its lines with a word goes."""
    word = r"[^\x20\x09-\x0D]"
    marked = docs.withColumn("_worded", F.col("text").rlike(word))
    with settings(spark, MERGED):
        found = dedup_lines(marked)
    left = found.filter(F.col("text").isNull() | (F.col("text") != "") & (~F.col("_worded") | F.col("text").rlike(word)))
    return left.drop("_worded")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8), that of the smallest doc_id."""
    with settings(spark, MERGED):
        return near_duplicate_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces."""
    return op3_best_fit(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Language models and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
