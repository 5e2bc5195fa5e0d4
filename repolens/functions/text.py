"""Texts, lines, positions of matches, and hashes, as columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "\x01"
_BLOCK = 64


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decoded(raw: Column | str) -> Column:
    """Text of raw bytes: bad UTF-8 becomes U+FFFD, one leading byte order mark goes, CRLF and CR become LF."""
    return normalised(F.call_function("make_valid_utf8", column(raw).cast("string")))


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(column(text), "^﻿", ""), "\r\n?", "\n")


def with_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row for each line (line_no from 1, line) of each file; a trailing newline leaves an empty last line."""
    rest = [c for c in files.columns if c not in (content, "line_no", "line")]
    return files.select(*rest, F.posexplode(F.split(content, "\n", -1)).alias("__pos", "line")).select(*rest, (F.col("__pos") + 1).alias("line_no"), "line")


def newline_count(text: Column | str) -> Column:
    return F.size(F.split(column(text), "\n", -1)) - 1


def shown_lines(text: Column | str) -> Column:
    """Lines that iterating over a file yields: an empty text has none, a trailing newline adds none."""
    text = column(text)
    return newline_count(text) + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)


def matches(files: DataFrame, pattern: str, groups: int | tuple[int, ...] = 1, content: str = "content", anchored: str | None = None) -> DataFrame:
    """One row for each match of a Java pattern in each file: line_no where it begins, ord, g1, g2, ...

    A mark before each match splits the text; the line is one more than the newlines before the mark. The
    groups are taken again at the beginning of each part, by ``anchored`` if the pattern looks behind itself.
    """
    rest = [c for c in files.columns if c not in (content, "line_no", "ord")]
    wanted = range(1, groups + 1) if isinstance(groups, int) else groups
    found = _placed(files.select(*rest, _parts(F.col(content), pattern).alias("__parts")), rest)
    return found.select(*rest, "line_no", "ord", *(F.regexp_extract(F.col("part"), _again(anchored or pattern), g).alias(f"g{g}") for g in wanted))


def matches_of(files: DataFrame, rules: list[tuple[str, int]], content: str = "content") -> DataFrame:
    """One row for each match of each (Java pattern, group) in each file: rule (its place), line_no, ord, g; one read of the files."""
    rest = [c for c in files.columns if c not in (content, "rule", "line_no", "ord", "g")]
    each = F.array(*(F.struct(F.lit(i).alias("rule"), _parts(F.col(content), pattern).alias("parts")) for i, (pattern, _) in enumerate(rules)))
    split = files.select(*rest, F.explode(F.filter(each, lambda r: F.size(r["parts"]) > 1)).alias("__r")).select(*rest, F.col("__r.rule").alias("rule"), F.col("__r.parts").alias("__parts"))
    found = _placed(split, [*rest, "rule"])
    group = F.lit(None).cast("string")
    for i, (pattern, g) in enumerate(rules):
        group = F.when(F.col("rule") == i, F.regexp_extract(F.col("part"), _again(pattern), g)).otherwise(group)
    return found.select(*rest, "rule", "line_no", "ord", group.alias("g"))


def _parts(text: Column, pattern: str) -> Column:
    """The text before the first match of a pattern, then from each match to the next."""
    return F.split(F.regexp_replace(text, pattern, MARK + "$0"), MARK, -1)


def _again(pattern: str) -> str:
    flags, body = _flags(pattern)
    return f"{flags}\\A(?:{body})"


def _placed(split: DataFrame, rest: list[str]) -> DataFrame:
    """The rest columns, ord, line_no and part of each match, from __parts."""
    added = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
    parts = F.col("__parts")
    # newlines before a part: whole blocks of parts, then the rest of its block
    split = split.withColumn("__n", F.transform(parts, lambda p: F.size(F.split(p, "\n", -1)) - 1))
    split = split.withColumn("__blocks", F.transform(F.sequence(F.lit(0), F.size("__n"), F.lit(_BLOCK)), lambda at: added(F.slice("__n", at + 1, F.lit(_BLOCK)))))
    before = lambda i: added(F.slice("__blocks", F.lit(1), F.floor(i / _BLOCK).cast("int"))) + added(F.slice("__n", (i - i % _BLOCK) + 1, i % _BLOCK))
    hits = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("part"), i.alias("ord"), (before(i + 1) + 1).alias("line_no")))
    return split.select(*rest, F.explode(hits).alias("m")).select(*rest, F.col("m.part").alias("part"), F.col("m.ord").alias("ord"), F.col("m.line_no").alias("line_no"))


def _flags(pattern: str) -> tuple[str, str]:
    if pattern.startswith("(?") and ")" in pattern and pattern[2 : pattern.index(")")].isalpha():
        at = pattern.index(")") + 1
        return pattern[:at], pattern[at:]
    return "", pattern


def checksum(text: Column | str) -> Column:
    """First 12 hex digits of SHA-256."""
    return F.substring(F.sha2(column(text), 256), 1, 12)


def line_hash(line: Column | str) -> Column:
    """Two letters from the first eight bytes of SHA-256, little-endian, modulo 676; carriage returns do not count."""
    digest = F.sha2(F.rtrim(F.replace(column(line), F.lit("\r"), F.lit("")), F.lit("\n")), 256)
    swapped = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))))
    n = (F.conv(swapped, 16, 10).cast("decimal(20,0)") % 676).cast("int")
    letter = lambda x: F.chr((97 + x).cast("bigint"))
    return F.concat(letter(F.floor(n / 26)), letter(n % 26))


def shortened(value: Column | str, most: int = 80, head: int = 40, tail: int = 37) -> Column:
    """Long values keep their ends: the first 40 characters, three dots, the last 37."""
    value = column(value)
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, head), F.lit("..."), F.right(value, F.lit(tail)))).otherwise(value)


def first_upper(word: Column | str) -> Column:
    """First letter upper-cased, the rest lower-cased."""
    word = column(word)
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def literal_count(text: Column | str, needle: str) -> Column:
    """How often a literal occurs, without regard to case or overlaps."""
    from .regex import literal

    return F.size(F.split(F.lower(column(text)), "(?u)" + literal(needle.lower()), -1)) - 1


def basename(path: Column | str) -> Column:
    return F.substring_index(column(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-cased extension with its dot, or empty: a leading dot begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order (dropDuplicates would keep any)."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")
