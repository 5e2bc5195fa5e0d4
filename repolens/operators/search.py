"""Searching lines, with context.

Context comes from the lines of a file's own row, so a search has no exchange.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import java, needles, whole_word
from ..functions.text import with_lines
from ..sources.files import included

LONGEST_PATTERN = 1000


def checked(pattern: str) -> str | None:
    """The Java pattern, or None if it is too long or not valid; such searches find nothing."""
    if len(pattern) > LONGEST_PATTERN:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return java(pattern)


def matching_lines(files: DataFrame, pattern: str, include: str | None = None) -> DataFrame:
    """(path, line_no, line) of lines in which the pattern occurs."""
    found = checked(pattern)
    if include is not None:
        files = files.where(included("path", include))
    lines = with_lines(_holding(files, pattern).select("path", "content"))
    return lines.where(F.col("line").rlike(found)) if found else lines.limit(0)


def _holding(files: DataFrame, pattern: str) -> DataFrame:
    """Files without those that hold none of the texts that a match needs; others are never split into lines."""
    texts = sorted(needles(pattern, fold=False) or ()) if checked(pattern) else []
    return files.where(reduce(Column.__or__, (F.col("content").contains(t) for t in texts))) if texts else files


def _hits(files: DataFrame, pattern: str) -> DataFrame:
    """(path, lines, hit: line_no and line) of each match; a file's lines stay together, so nothing is shuffled."""
    found = checked(pattern)
    split = _holding(files, pattern).select("path", F.split("content", "\n", -1).alias("lines"))
    if found is None:
        split = split.limit(0)
    numbered = F.transform("lines", lambda x, i: F.when(x.rlike(found or ""), F.struct((i + 1).alias("line_no"), x.alias("line"))))
    return split.select("path", "lines", F.explode(F.array_compact(numbered)).alias("hit"))


def search(files: DataFrame, pattern: str, include: str | None = None, context: int = 0) -> DataFrame:
    """(path, line_no, match, context_before, context_after): hits with up to ``context`` lines on each side."""
    if include is not None:
        files = files.where(included("path", include))
    at = F.col("hit.line_no")
    before = F.slice("lines", F.greatest(at - context, F.lit(1)), F.least(at - 1, F.lit(context)))
    after = F.slice("lines", at + 1, F.lit(context))
    return _hits(files, pattern).select("path", at.alias("line_no"), F.col("hit.line").alias("match"), before.alias("context_before"), after.alias("context_after"))


def search_file(files: DataFrame, path: str, pattern: str, context: int = 0) -> DataFrame:
    """(path, line_no, match, context) in one file; context: line numbers and lines around the hit, itself included."""
    at = F.col("hit.line_no")
    low = F.greatest(at - context, F.lit(1))
    frame = F.transform(F.slice("lines", low, at + context - low + 1), lambda x, i: F.struct((i + low).alias("line_no"), x.alias("line")))
    return _hits(files.where(F.col("path") == path), pattern).select("path", at.alias("line_no"), F.col("hit.line").alias("match"), frame.alias("context"))


def word_references(files: DataFrame, symbol: str, most: int = 120) -> DataFrame:
    """(type, path, line_no, context): lines with the whole word, one row each; context: 120 characters, trimmed."""
    lines = with_lines(files.where(F.col("content").contains(symbol)).select("path", "content")).where(F.col("line").contains(symbol) & F.col("line").rlike(whole_word(symbol)))
    return lines.select(F.lit("reference").alias("type"), "path", "line_no", F.btrim(F.substring("line", 1, most), F.lit(" \t\n\x0b\x0c\r")).alias("context"))


def tokens(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(path, line_no, token): every word of every line, the flat form of a token index."""
    lines = with_lines(files.select(*keep, "content"))
    return lines.select(*keep, "line_no", F.explode(F.regexp_extract_all("line", F.lit(java(r"(\w+)")), 1)).alias("token"))


def excluding_definitions(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References without those on a line of a definition."""
    return references.join(definitions.select("path", "line_no").distinct(), ["path", "line_no"], "left_anti")


def location(argument: str) -> tuple[str, int | None]:
    """path and line of an argument such as src/a.py:12; no line if there is none."""
    m = re.fullmatch(r"(.+?):(\d+)", argument)
    return (m[1], int(m[2])) if m else (argument, None)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order; n of 0 or less: all."""
    ranked = df.orderBy(*order)
    return ranked.limit(n) if n > 0 else ranked
