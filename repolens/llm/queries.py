"""The thin queries of the subpackage: one per operator, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_report
from .chunks import chunk_report
from .common import table
from .decontaminate import contamination_report
from .langid import language_report
from .licenses import license_report
from .lm import lm_report
from .mixing import BLOCK_ROWS, mix
from .neardup import near_duplicates
from .quality import QUALITY_SQL, quality
from .sql import DECONTAMINATION_SQL, NEAR_DEDUP_SQL, mix_sql
from .substrings import substring_report


#: Target weights of the corpus mix; sources beyond these share weight 1.
MIX_WEIGHTS = {f"src{i}": 8 if i < 5 else 5 if i < 10 else 3 for i in range(20)}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, other=1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_report(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"), least=400, words=51)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_report(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_language_id": op2_language_id,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_chunk_dedup": op4_chunk_dedup,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_license_scan": op8_license_scan,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mix_sql(MIX_WEIGHTS, 1, BLOCK_ROWS),
        "op3_benchmark_decontamination": DECONTAMINATION_SQL,
        "op6_minhash_near_dedup": NEAR_DEDUP_SQL,
        "op7_quality_rules": QUALITY_SQL,
    }
