"""TODO-style markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import java
from ..functions.text import matches

# Tags in their order of report.
TAGS = ("TODO", "FIXME", "HACK", "XXX", "BUG", "OPTIMIZE", "NOTE", "REVIEW", "WORKAROUND")
_BODY = "(" + "|".join(TAGS) + r")(?:\(([^)]*)\))?\s*:\s*([^\n]*)"


def markers(files: DataFrame) -> DataFrame:
    """(path, line_no, ord, tag, author, message) of each marker.

    Any case counts, but no word character may stand before. White space around the colon may hold a newline,
    so a marker that ends its line takes the next line as its message.
    """
    found = matches(files.select("path", "content"), java(r"(?i)(?<!\w)" + _BODY), 3, anchored=java(r"(?i)" + _BODY))
    return found.select("path", "line_no", "ord", F.upper("g1").alias("tag"), F.col("g2").alias("author"), F.btrim("g3", F.lit(" \t\n\x0b\x0c\r")).alias("message"))


def by_tag(found: DataFrame) -> DataFrame:
    """(tag, ord, n) of the tags that occur, in their fixed order (ord)."""
    place = F.array_position(F.array(*(F.lit(t) for t in TAGS)), F.col("tag"))
    return found.groupBy("tag").agg(F.count("*").alias("n")).withColumn("ord", place.cast("int")).orderBy("ord")


def by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("path", "tag").agg(F.count("*").alias("n"))


def bar(n: str = "n") -> Column:
    """A bar of one block for each, 40 at most."""
    return F.repeat(F.lit("█"), F.least(F.col(n), F.lit(40)).cast("int"))
