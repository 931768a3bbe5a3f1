"""The registered queries of this subpackage: thin calls of its operators on the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import parityjoin, toolcalls
from docloom.llm.decontam import op7_qgram_decontamination
from docloom.llm.huffman import op10_huffman_ids
from docloom.llm.langid import op6_cross_parsing
from docloom.llm.linededup import op9_line_dedup
from docloom.llm.packing import op3_best_fit
from docloom.llm.parityjoin import op2_parity_join
from docloom.llm.perplexity import op1_perplexity
from docloom.llm.qualityfm import op5_factorisation_machine
from docloom.llm.surrogates import op8_surrogates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_perplexity(table(spark, sf_dir, "documents"))


def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_parity_join(table(spark, sf_dir, "documents"))


def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_best_fit(table(spark, sf_dir, "documents"))


def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.op4_tool_calls(table(spark, sf_dir, "conversations"))


def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_factorisation_machine(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_cross_parsing(table(spark, sf_dir, "documents"))


def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_qgram_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_surrogates(table(spark, sf_dir, "documents"))


def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_line_dedup(table(spark, sf_dir, "documents"))


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op10_huffman_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), literal=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_perplexity": q1, "op2_parity_join": q2, "op3_best_fit": q3, "op4_tool_calls": q4, "op5_factorisation_machine": q5,
        "op6_cross_parsing": q6, "op7_qgram_decontamination": q7, "op8_surrogates": q8, "op9_line_dedup": q9, "op10_huffman_ids": q10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_parity_join": parityjoin.ORACLE, "op4_tool_calls": toolcalls.ORACLE}
