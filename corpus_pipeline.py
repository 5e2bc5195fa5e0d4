"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what is left of docs; all but the last return the columns
of documents. A runner may write each stage's result and read it again; run() cuts the lineage between stages
instead, so that no stage is computed twice and a lost executor costs at most its own stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm.common import settle, table
from repolens.llm.decontaminate import decontaminated
from repolens.llm.langid import only_identified
from repolens.llm.mixing import mix
from repolens.llm.neardup import without_near_duplicates
from repolens.llm.queries import MIX_WEIGHTS
from repolens.llm.substrings import remove_passages


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or less than half of their letters in learned languages."""
    return only_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 400 bytes, that occur more than once are cut out of texts; n_chars follows. Every row stays."""
    return remove_passages(docs, words=51).withColumn("n_chars", F.length("text").cast("bigint")).select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold ten consecutive words of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix, with phase, block, slot and position."""
    return mix(docs, MIX_WEIGHTS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Minhashing, suffix arrays and Viterbi are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
