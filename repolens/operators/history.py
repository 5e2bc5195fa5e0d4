"""Churn and changelogs from commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import java
from ..functions.text import first_upper

# Commit types and their categories, and the categories in their order of report.
CATEGORIES = {
    "feat": "Features", "feature": "Features", "fix": "Bug Fixes", "bugfix": "Bug Fixes", "docs": "Documentation", "doc": "Documentation",
    "refactor": "Refactoring", "refactoring": "Refactoring", "test": "Tests", "tests": "Tests", "ci": "CI", "chore": "Chores",
    "perf": "Performance", "perfomance": "Performance", "style": "Style", "build": "Build", "revert": "Reverts",
}
ORDER = ("Features", "Bug Fixes", "Performance", "Refactoring", "Tests", "Documentation", "Style", "Build", "CI", "Chores", "Reverts", "Other")

_COMMIT = java(r"^([a-f0-9]+) (?:\(([^)]*)\)\s+)?(.+)$")
_CONVENTIONAL = java(r"^(\w+)(?:\(([^)]*)\))?(!)?:\s*(.+)$")


def churn(commit_files: DataFrame, top: int = 20, least: int = 2, tie: str = "first_seen") -> DataFrame:
    """(file, commits): files in at least ``least`` commits, the most frequent first.

    commit_files: (seq, file), seq ascending from the newest commit. Ties keep the order in which files are
    first seen; tie="file" sorts them by name. top of 0 or less: all.
    """
    counted = commit_files.groupBy("file").agg(F.count("*").alias("commits"), F.min("seq").alias("first_seen")).where(F.col("commits") >= least)
    ranked = counted.orderBy(F.desc("commits"), F.asc(tie), F.asc("file")).select("file", "commits")
    return ranked.limit(top) if top > 0 else ranked


def parse_commits(lines: DataFrame, column: str = "line") -> DataFrame:
    """All columns but the line, and hash, category, scope, breaking, subject, raw; lines without a hash go.

    Types are looked up as written; an unknown type is its own category, capitalised. Subjects of no type are
    Other.
    """
    rest = [c for c in lines.columns if c not in (column, "hash", "category", "scope", "breaking", "subject", "raw")]
    found = lines.where(F.col(column).rlike(_COMMIT)).select(*rest, F.regexp_extract(column, _COMMIT, 1).alias("hash"), F.regexp_extract(column, _COMMIT, 3).alias("raw"))
    conventional = F.col("raw").rlike(_CONVENTIONAL)
    kind = F.regexp_extract("raw", _CONVENTIONAL, 1)
    known = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return found.select(
        *rest,
        "hash",
        F.when(conventional, F.coalesce(known[kind], first_upper(kind))).otherwise("Other").alias("category"),
        F.when(conventional, F.regexp_extract("raw", _CONVENTIONAL, 2)).otherwise("").alias("scope"),
        (conventional & (F.regexp_extract("raw", _CONVENTIONAL, 3) == "!")).alias("breaking"),
        F.when(conventional, F.regexp_extract("raw", _CONVENTIONAL, 4)).otherwise(F.col("raw")).alias("subject"),
        "raw",
    )


def grouped(commits: DataFrame) -> DataFrame:
    """(ord, category, n, breaking) of the twelve categories that the text form shows; others do not appear in it."""
    place = F.array_position(F.array(*(F.lit(c) for c in ORDER)), F.col("category"))
    return commits.where(F.col("category").isin(*ORDER)).groupBy("category").agg(F.count("*").alias("n"), F.count_if("breaking").alias("breaking")).withColumn("ord", place.cast("int"))
