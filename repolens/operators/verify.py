"""Checks of a text against expectations: summaries, occurrences, lines, replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import checksum, literal_count, shown_lines, with_lines


def summary(files: DataFrame) -> DataFrame:
    """(path, lines, bytes, checksum); bytes counts characters of the text."""
    return files.select("path", shown_lines("content").cast("bigint").alias("lines"), F.length("content").cast("bigint").alias("bytes"), checksum("content").alias("checksum"))


def first_line(content: str, needle: str):
    """Number of the first line with a literal, case aside, or null."""
    at = F.locate(needle.lower(), F.lower(F.col(content)))
    return F.when(at > 0, F.size(F.split(F.substring(F.lower(F.col(content)), F.lit(1), at), "\n", -1)))


def contains(files: DataFrame, needle: str, should: bool = True) -> DataFrame:
    """(path, ok, line, count): whether a literal occurs, case aside; should=False asks for its absence."""
    count = literal_count("content", needle)
    return files.select("path", ((count > 0) if should else (count == 0)).alias("ok"), first_line("content", needle).alias("line"), count.cast("bigint").alias("count"))


def line_check(files: DataFrame, line_no: int, expected: str) -> DataFrame:
    """(path, ok, actual): whether a line has a literal, case and all; null actual: there is no such line."""
    line = F.get(F.split("content", "\n", -1), F.lit(line_no - 1)) if line_no > 0 else F.lit(None).cast("string")
    return files.select("path", F.coalesce(F.contains(line, F.lit(expected)), F.lit(False)).alias("ok"), F.substring(line, 1, 200).alias("actual"))


def replaced(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, ok, old_count, new_count, old_line, new_line): ok if the old text is gone and the new one there."""
    a, b = literal_count("content", old), literal_count("content", new)
    return files.select("path", ((a == 0) & (b > 0)).alias("ok"), a.cast("bigint").alias("old_count"), b.cast("bigint").alias("new_count"), first_line("content", old).alias("old_line"), first_line("content", new).alias("new_line"))


def context(files: DataFrame, target: int, around: int) -> DataFrame:
    """(path, line_no, line, is_target): lines target - around + 1 to target + around + 1 that exist.

    The frame leans to the lines after the target.
    """
    lines = with_lines(files.select("path", "content"))
    low = max(1, target - around + 1)
    return lines.where(F.col("line_no").between(low, target + around + 1)).withColumn("is_target", F.col("line_no") == target)
