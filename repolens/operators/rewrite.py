"""Rewriting texts: renames, spans, replacements, and edits anchored to line hashes.

Every operator returns new texts; nothing is written. ``write_back`` is the only one that touches files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import literal, replacement, whole_word
from ..functions.text import line_hash, with_lines
from ..functions.workers import importable
from .symbols import blanked


def renamed(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, content, changed): every whole word old replaced by new, taken literally."""
    text = F.when(F.col("content").contains(old), F.regexp_replace("content", whole_word(old), replacement(new))).otherwise(F.col("content"))
    return files.select("path", text.alias("__new"), "content").select("path", F.col("__new").alias("content"), (F.col("__new") != F.col("content")).alias("changed"))


def rename_counts(files: DataFrame, old: str) -> DataFrame:
    """(path, occurrences): lines, not hits, with the word; files without it are left out."""
    lines = with_lines(files.where(F.col("content").contains(old)).select("path", "content")).where(F.col("line").contains(old) & F.col("line").rlike(whole_word(old)))
    return lines.groupBy("path").agg(F.count("*").alias("occurrences"))


def word_spans(files: DataFrame, word: str) -> DataFrame:
    """(path, line, col): place of every whole word; col counts characters from 0."""
    lines = with_lines(files.where(F.col("content").contains(word)).select("path", "content"))
    parts = F.split(F.regexp_replace("line", whole_word(word), "\x01$0"), "\x01", -1)
    starts = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out")),
        lambda s: s["out"],
    )
    return lines.where(F.col("line").contains(word)).select("path", F.col("line_no").alias("line"), F.explode(starts).alias("col"))


def typescript_spans(files: DataFrame, symbol: str) -> DataFrame:
    """(path, line, col, kind) of a symbol in TypeScript files, outside strings and comments.

    Neither a dollar sign nor a dot before it, nor a word character or dollar sign behind it. kind: definition
    behind a declaring word, import on an import line, else reference.
    """
    pattern = r"(?d)(?<![\p{L}\p{N}_$.])" + literal(symbol) + r"(?![\p{L}\p{N}_$])"
    clear = files.where(F.col("lang") == "ts").select("path", blanked(F.col("content")).alias("content"))
    lines = with_lines(clear).where(F.col("line").contains(symbol))
    parts = F.split(F.regexp_replace("line", pattern, "\x01$0"), "\x01", -1)
    before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), ""))
    found = lines.where(F.size(parts) > 1).select("path", "line_no", "line", F.explode(before).alias("head"))
    defined = F.col("head").rlike(r"(function|class|interface|type|enum|const|let|var)\s+\*?\s*$")
    kind = F.when(defined, "definition").when(F.col("line").rlike(r"^\s*import\b"), "import").otherwise("reference")
    return found.select("path", F.col("line_no").alias("line"), F.length("head").alias("col"), kind.alias("kind"))


def apply_spans(files: DataFrame, spans: DataFrame, old_length: int, new: str) -> DataFrame:
    """(path, content, spans): each span (path, line, col) of old_length characters becomes new.

    Spans of a line apply from right to left, so that none moves another. Files without spans are left out.
    Only spans are grouped; a file's text meets them in one join by path.
    """
    by_line = spans.groupBy("path", "line").agg(F.sort_array(F.collect_set("col"), asc=False).alias("cols"))
    by_file = by_line.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("line", "cols"))).alias("at"), F.sum(F.size("cols")).alias("spans"))
    put = lambda text, c: F.concat(F.substring(text, F.lit(1), c), F.lit(new), F.substring(text, c + old_length + 1, F.lit(1 << 30)))
    none = F.array().cast("array<int>")
    edited = F.transform(F.split("content", "\n", -1), lambda x, i: F.aggregate(F.coalesce(F.try_element_at("at", i + 1), none), x, put))
    return files.select("path", "content").join(by_file, "path").select("path", F.array_join(edited, "\n").alias("content"), "spans")


def replaced_first(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, status, content): the first exact occurrence replaced; CRLF and one trailing newline of old do not count."""
    found, text = _first_place(old, new)
    return files.select("path", F.when(found, "replaced").otherwise("not found").alias("status"), F.when(found, text).otherwise(F.col("content")).alias("content"))


def _first_place(old: str, new: str) -> tuple[Column, Column]:
    """Whether the content holds old on normalised line ends, and the content with its first occurrence replaced."""
    old = re.sub(r"\n$", "", old.replace("\r\n", "\n"))
    at = F.locate(old, F.col("content"))
    return at > 0, F.concat(F.substring(F.col("content"), F.lit(1), at - 1), F.lit(new), F.substring(F.col("content"), at + len(old), F.lit(1 << 30)))


def hashed_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, hash, shown): every line with its two-letter hash, shown as 12ab|text."""
    lines = with_lines(files.select("path", "content")).withColumn("hash", line_hash("line"))
    return lines.select("path", "line_no", "hash", F.concat(F.col("line_no").cast("string"), "hash", F.lit("|"), "line").alias("shown"))


# Edits: kind insert or delete; cursor bof, eof, before or after a line; anchor line and hash; text; idx.
EDIT_SCHEMA = "section int, kind string, cursor string, anchor_line int, anchor_hash string, text string, line_num int, idx int"
INTERIOR = "**"
# Lines around a patch.
PATCH_MARKS = ("*** Begin Patch", "*** End Patch", "*** Abort")


class EditError(ValueError):
    """An edit text that does not follow the format."""


def anchor(raw: str) -> tuple[int, str]:
    m = re.fullmatch(r"(\d+)([a-z]{2})", raw.lower())
    if not m:
        raise EditError(f"anchor {raw!r} is not a line number and two letters")
    return int(m[1]), m[2]


def _range(raw: str) -> list[tuple[int, str]]:
    ends = raw.split("..")
    if len(ends) != 2:
        raise EditError(f"range {raw!r} is not ANCHOR..ANCHOR")
    (a, x), (b, y) = anchor(ends[0]), anchor(ends[1])
    if b < a or (a == b and x != y):
        raise EditError(f"range {raw!r} ends before it begins, or gives one line two hashes")
    return [(a, x)] if a == b else [(a, x), *((n, INTERIOR) for n in range(a + 1, b)), (b, y)]


def parse_edits(text: str) -> list[tuple]:
    """Rows of EDIT_SCHEMA from an edit text; every @@ section is one more edit of the same file."""
    rows: list[tuple] = []
    section, idx, seen_section = 0, 0, False
    lines = text.split("\n")
    i = 0

    def payload(needed: bool, number: int) -> list[str]:
        nonlocal i
        out = []
        while i < len(lines) and lines[i].startswith("~"):
            out.append(lines[i][1:])
            i += 1
        if needed and not out:
            raise EditError(f"line {number}: an insertion needs lines that begin with ~")
        return out

    def add(kind, cursor, at, body, number):
        nonlocal idx
        rows.append((section, kind, cursor, at[0] if at else None, at[1] if at else None, body, number, idx))
        idx += 1

    while i < len(lines):
        raw, number = lines[i].strip(), i + 1
        i += 1
        if raw == PATCH_MARKS[2]:
            break
        if not raw or raw in PATCH_MARKS:
            continue
        if raw.startswith("@@"):
            section += 1 if seen_section or rows else 0
            seen_section = True
            continue
        op, _, rest = raw.partition(" ")
        rest = rest.strip()
        if op in ("+", "<") and rest and " " not in rest:
            edge = rest.lower() if rest.upper() in ("BOF", "EOF") else None
            at = None if edge else anchor(rest)
            for body in payload(True, number):
                add("insert", edge or ("after" if op == "+" else "before"), at, body, number)
        elif op == "-" and rest:
            for at in _range(rest):
                add("delete", "at", at, None, number)
        elif op == "=" and rest:
            span = _range(rest)
            for body in payload(False, number) or [""]:
                add("insert", "before", span[0], body, number)
            for at in span:
                add("delete", "at", at, None, number)
        else:
            raise EditError(f"line {number}: unexpected {raw!r}")
    return rows


def mismatches(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, anchor_line, expected, actual): anchors whose line has another hash or does not exist.

    edits: (path, kind, cursor, anchor_line, anchor_hash, ...). Inner lines of ranges and lines that text is
    inserted after are not checked.
    """
    checked = edits.where(F.col("anchor_line").isNotNull() & (F.col("anchor_hash") != INTERIOR) & (F.col("cursor") != "after")).select("path", F.col("anchor_line").alias("line_no"), F.col("anchor_hash").alias("expected")).distinct()
    lines = hashed_lines(files).select("path", "line_no", F.col("hash").alias("actual"))
    return checked.join(lines, ["path", "line_no"], "left").where("actual IS NULL OR actual != expected").select("path", F.col("line_no").alias("anchor_line"), "expected", "actual")


def mismatch_report(files: DataFrame, wrong: DataFrame, around: int = 2) -> DataFrame:
    """(path, line_no, mark, shown, gap): lines near mismatches with their hashes; gap: lines are left out before."""
    from pyspark.sql import Window

    near = wrong.select("path", "anchor_line", F.explode(F.sequence(F.col("anchor_line") - around, F.col("anchor_line") + around)).alias("line_no"))
    wanted = near.groupBy("path", "line_no").agg(F.max((F.col("anchor_line") == F.col("line_no")).cast("int")).alias("hit"))
    shown = hashed_lines(files).join(wanted, ["path", "line_no"])
    before = F.lag("line_no").over(Window.partitionBy("path").orderBy("line_no"))
    return shown.select("path", "line_no", F.when(F.col("hit") == 1, "*").otherwise(" ").alias("mark"), "shown", F.coalesce(F.col("line_no") - before > 1, F.lit(False)).alias("gap"))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content) of files with edits (path, kind, cursor, anchor_line, text, idx), all anchors being right.

    Nothing is mutated: each line becomes the texts inserted before it and, unless deleted, itself; the lines
    are then laid in order between the texts for the file's beginning and end. Text after the last line goes
    to the end. Text for an empty file's beginning or end takes the place of its only line. A file whose content
    is null is left out.
    """
    # one row a file, keyed by twice the line that texts stand before, plus one if they were put after the line above
    after = F.col("cursor") == "after"
    edge = F.when(F.col("cursor") == "bof", -2).when(F.col("cursor") == "eof", -1)
    slot = F.coalesce(edge, 2 * F.col("anchor_line") + F.when(after, 3).otherwise(0))
    inserted = F.when(F.col("kind") == "insert", F.struct("idx", "text"))
    at_slot = edits.repartition("path").select("path", slot.alias("slot"), inserted.alias("put"), (F.col("kind") == "delete").alias("del")).groupBy("path", "slot").agg(F.collect_list("put").alias("put"), F.bool_or("del").alias("gone"))
    by_file = at_slot.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("put", "gone").alias("e")))).alias("at"))
    laid = files.where(F.col("content").isNotNull()).select("path", F.split("content", "\n", -1).alias("lines")).join(by_file, "path")
    put = lambda key: F.coalesce(F.try_element_at("at", key)["put"], F.array().cast(at_slot.schema["put"].dataType))
    texts = lambda rows: F.transform(F.sort_array(rows), lambda r: r["text"])

    def laid_out(x, i):
        at = 2 * (i + 1)
        return F.concat(texts(F.concat(put(at), put(at + 1))), F.when(F.coalesce(F.try_element_at("at", at)["gone"], F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(x)))

    past = F.map_filter("at", lambda k, e: (k % 2 == 1) & (k > 2 * F.size("lines") + 1))
    tail = F.concat(put(F.lit(-1)), F.flatten(F.transform(F.map_values(past), lambda e: e["put"])))
    laid = laid.select("path", F.flatten(F.transform("lines", laid_out)).alias("body"), texts(put(F.lit(-2))).alias("bof"), texts(tail).alias("eof"))
    alone = lambda own, body: (F.size(own) > 0) & (F.size(body) == 1) & (F.get(body, F.lit(0)) == "")
    laid = laid.select("path", "eof", F.when(alone("bof", "body"), F.col("bof")).otherwise(F.concat("bof", "body")).alias("body"))
    last = F.when(alone("eof", "body"), F.col("eof")).otherwise(F.concat("body", "eof"))
    return laid.select("path", F.array_join(last, "\n").alias("content"))


def apply_sections(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, content) of one file after an edit text: each section edits what the one before has left."""
    spark = files.sparkSession
    # the path comes from rows, not from a literal, which would turn the joins by path into cross joins
    now = files.join(spark.createDataFrame([(path,)], "path string"), "path", "left_semi").select("path", "content")
    rows = parse_edits(text)
    for section in sorted({r[0] for r in rows}):
        edits = spark.createDataFrame([(*r, path) for r in rows if r[0] == section], EDIT_SCHEMA + ", path string")
        if not (wrong := mismatches(now, edits).limit(1)).isEmpty():
            raise EditError(f"anchors do not match, such as {wrong.first().asDict()}")
        now = apply_edits(now, edits)
    return now


def unified_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, diff) of files that differ, three lines of context."""
    importable(before.sparkSession)
    pairs = before.select("path", F.col("content").alias("old")).join(after.select("path", F.col("content").alias("new")), "path").where("old != new")
    return pairs.mapInPandas(_diffs, "path string, diff string")


def _diffs(frames):
    import difflib

    for frame in frames:
        text = ["\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), f"a/{p}", f"b/{p}", lineterm="")) for p, a, b in zip(frame["path"], frame["old"], frame["new"])]
        yield frame[["path"]].assign(diff=text)


def edit_stats(results: DataFrame, status: str = "status") -> DataFrame:
    """One row: calls, direct, salvaged, failed and rate (percent that succeeded, a whole number)."""
    n = lambda s: F.count_if(F.col(status) == s).alias(s)
    out = results.agg(F.count("*").alias("calls"), n("direct"), n("salvaged"), n("failed"))
    return out.withColumn("rate", F.floor(100 * (F.col("direct") + F.col("salvaged")) / F.greatest(F.col("calls"), F.lit(1)) + 0.5).cast("bigint"))


def edited_or_salvaged(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, status, content): an exact edit; failing that, one on normalised line ends; else failed (null: no status)."""
    text = F.col("content")
    exact, (salvaged, loose) = F.locate(old, text), _first_place(old, new)
    direct = F.concat(F.substring(text, F.lit(1), exact - 1), F.lit(new), F.substring(text, exact + len(old), F.lit(1 << 30)))
    status = F.when(exact > 0, "direct").when(salvaged, "salvaged").when(text.isNotNull(), "failed")
    return files.select("path", status.alias("status"), F.when(exact > 0, direct).when(salvaged, loose).otherwise(text).alias("content"))


def write_back(changed: DataFrame, root: str) -> None:
    """Write (path, content) below a folder that every executor sees; the only operator with an effect on files."""

    def put(rows):
        import os

        for r in rows:
            full = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8", newline="") as f:
                f.write(r["content"])

    changed.select("path", "content").foreachPartition(put)

