"""Ordered aggregates: offsets, budgets, caps, status and warnings.

Windows partition by document; a document has at most a few hundred parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.contract import PARTIAL, RULES, WARNINGS
from docloom.functions.text import utf16_len, utf16_slice


def char_offsets(parts: DataFrame, doc: list[str], index: str, text: str) -> DataFrame:
    """``char_start`` and ``char_end``: running UTF-16 length in index order."""
    by = Window.partitionBy(*doc).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = utf16_len(F.col(text))
    end = F.sum(size).over(by).cast("int")
    return parts.withColumn("char_start", (end - size).cast("int")).withColumn("char_end", end)


def full_text(parts: DataFrame, doc: list[str], index: str, text: str) -> DataFrame:
    """All texts of a document joined in index order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t"))))
    return parts.groupBy(*doc).agg(F.array_join(F.transform(ordered, lambda s: F.coalesce(s["t"], F.lit(""))), "").alias("full_text"))


def page_slice(parts: DataFrame, doc: list[str], index: str, text: str, start: int, end: int) -> DataFrame:
    """UTF-16 units ``start`` to ``end`` of the document's text; a bad range raises E_USAGE."""
    from docloom.contract import ExtractionFailed

    if start < 0 or end < start:
        raise ExtractionFailed("E_USAGE")
    whole = full_text(parts, doc, index, text)
    size = utf16_len(F.col("full_text"))
    piece = utf16_slice(F.col("full_text"), F.least(F.lit(start), size), F.least(F.lit(end), size))
    return whole.select(*doc, piece.alias("page"))


def output_budget(parts: DataFrame, doc: list[str], index: str, text: str, cap: int) -> DataFrame:
    """``taken`` units and ``kept`` text of each part when ``cap`` units go to the parts in order.

    A fold over the document's parts: a part cut before half a character leaves a unit to the next.
    """
    item = F.struct(F.col(index).alias("i"), F.col(text).alias("t"))
    start = F.struct(F.lit(cap).alias("left"), F.array().cast("array<struct<i:bigint,n:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        size = utf16_len(x["t"])
        half = F.hex(F.substring(F.encode(x["t"], "UTF-16LE"), 2 * acc["left"], F.lit(1))).rlike("^D[89AB]$") & (acc["left"] > 0)
        n = F.when(size <= acc["left"], size).otherwise(acc["left"] - half.cast("int"))
        return F.struct((acc["left"] - n).cast("int").alias("left"), F.concat(acc["out"], F.array(F.struct(x["i"].cast("bigint").alias("i"), n.cast("int").alias("n")))).alias("out"))

    folded = parts.groupBy(*doc).agg(F.sort_array(F.collect_list(item)).alias("items")).select(*doc, F.explode(F.aggregate("items", start, step)["out"]).alias("o"))
    taken = folded.select(*(F.col(c).alias(f"_doc_{c}") for c in doc), F.col("o.i").alias("_index"), F.col("o.n").alias("taken"))
    out = parts.join(taken, [*(F.col(c).eqNullSafe(F.col(f"_doc_{c}")) for c in doc), F.col(index) == F.col("_index")])
    kept = utf16_slice(F.col(text), F.lit(0), F.col("taken"))
    return out.select(*parts.columns, "taken", kept.alias("kept"), (F.col("taken") < utf16_len(F.col(text))).alias("truncated"))


def first_n(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group: part, image and listing caps."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def status_rollup(parts: DataFrame, doc: list[str]) -> DataFrame:
    """total_chars, truncated, any_partial and status of each document from its parts."""
    partial = F.exists("warnings", lambda w: w["code"].isin(*PARTIAL))
    out = parts.groupBy(*doc).agg(F.max("char_end").alias("total_chars"), F.bool_or("truncated").alias("truncated"), F.bool_or(partial).alias("any_partial"))
    return out.withColumn("status", F.when(F.col("truncated") | F.col("any_partial"), "partial").otherwise("ok"))


def warning_table(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(k, v) for k, v in WARNINGS.items()], "code string, partial boolean")


def rule_table(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(RULES, "condition string, code string, severity string, blocks boolean")
