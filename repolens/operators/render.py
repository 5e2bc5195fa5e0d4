"""Reports as text: one row (report) each, laid out by DataFrame functions from bounded, ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import path_tree
from .history import ORDER
from .lint import level, shown


def _laid(rows: DataFrame, line: Column, *order: str) -> DataFrame:
    """One row with the lines in order."""
    pairs = rows.select(F.struct(*order, line.alias("__line")).alias("r"))
    return pairs.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["__line"]), "\n").alias("report"))


def churn_text(churn: DataFrame) -> DataFrame:
    """Commits, a bar and the file, the busiest first. churn: (file, commits), already cut to its top."""
    bar = F.repeat(F.lit("█"), F.least(F.col("commits"), F.lit(40)).cast("int"))
    rows = churn.withColumn("__o", -F.col("commits"))
    return _laid(rows, F.concat_ws(" ", F.lpad(F.col("commits").cast("string"), 5, " "), bar, "file"), "__o", "file")


def markers_text(markers: DataFrame, most: int = 200) -> DataFrame:
    """path:line [TAG] (author) message, by file and line; the first rows, as a report is read by people."""
    author = F.when(F.col("author") != "", F.concat(F.lit("("), "author", F.lit(") "))).otherwise("")
    rows = markers.orderBy("path", "line_no", "ord").limit(most)
    return _laid(rows, F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(" ["), "tag", F.lit("] "), author, "message"), "path", "line_no", "ord")


def changelog_text(commits: DataFrame, number: str = "seq", most: int = 1000) -> DataFrame:
    """The twelve categories in order, a heading and one line for each commit; other categories are left out."""
    place = F.array_position(F.array(*(F.lit(c) for c in ORDER)), F.col("category"))
    rows = commits.where(F.col("category").isin(*ORDER)).withColumn("__o", place).orderBy("__o", number).limit(most)
    scope = F.when(F.col("scope") != "", F.concat(F.lit("**"), "scope", F.lit("**: "))).otherwise("")
    mark = F.when(F.col("breaking"), F.lit(" (breaking)")).otherwise("")
    lines = rows.select("__o", "category", F.col(number).alias("__n"), F.concat(F.lit("- "), scope, "subject", mark, F.lit(" ("), "hash", F.lit(")")).alias("l"))
    heads = rows.select("__o", "category").distinct().select("__o", "category", F.lit(-1).cast("bigint").alias("__n"), F.concat(F.lit("## "), "category").alias("l"))
    return _laid(lines.select("__o", "category", F.col("__n").cast("bigint").alias("__n"), "l").unionByName(heads), F.col("l"), "__o", "__n")


def lint_text(issues: DataFrame, *order: str, most: int = 30) -> DataFrame:
    """E/W/I file:line:col message, errors first, thirty at most."""
    col = F.when(F.col("col").isNotNull(), F.concat(F.lit(":"), F.col("col").cast("string"))).otherwise("")
    letter = F.upper(F.substring(F.coalesce("severity", F.lit("?")), 1, 1))
    rows = shown(issues, *order, most=most).withColumn("__o", F.array_position(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), level()))
    return _laid(rows, F.concat(letter, F.lit(" "), "file", F.lit(":"), F.col("line").cast("string"), col, F.lit(" "), "message"), "__o", *order)


def index_text(tags: DataFrame, names: int = 50, places: int = 3) -> DataFrame:
    """The first fifty names with up to three places each and how many more there are."""
    place = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    counted = tags.groupBy("name").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set(place)), 1, places).alias("at")).orderBy("name").limit(names)
    more = F.when(F.col("n") > places, F.concat(F.lit(" … "), (F.col("n") - places).cast("string"), F.lit(" more"))).otherwise("")
    return _laid(counted, F.concat("name", F.lit(": "), F.array_join("at", ", "), more), "name")


def impact_text(found: DataFrame) -> DataFrame:
    """Sections of an impact report (section, path, line, type, more), a heading and a line for each row."""
    place = F.array_position(F.array(F.lit("definition"), F.lit("reference"), F.lit("test")), F.col("section"))
    rows = found.withColumn("__o", place)
    lines = rows.select("__o", F.lit(1).alias("__k"), "path", "line", F.concat(F.lit("  "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "type").alias("l"))
    heads = rows.groupBy("__o", "section").agg(F.max("more").alias("more"), F.count("*").alias("n"))
    heads = heads.select("__o", F.lit(0).alias("__k"), F.lit("").alias("path"), F.lit(0).alias("line"), F.concat("section", F.lit(" ("), (F.col("n") + F.col("more")).cast("string"), F.lit(")")).alias("l"))
    tails = rows.where("more > 0").groupBy("__o").agg(F.max("more").alias("more"))
    tails = tails.select("__o", F.lit(2).alias("__k"), F.lit("").alias("path"), F.lit(0).alias("line"), F.concat(F.lit("  … "), F.col("more").cast("string"), F.lit(" more")).alias("l"))
    return _laid(lines.unionByName(heads).unionByName(tails), F.col("l"), "__o", "__k", "path", "line")


def refactor_text(spans: DataFrame, most: int = 1000) -> DataFrame:
    """path:line:col  kind of the places that a rename touches, by path and place."""
    rows = spans.orderBy("path", "line", "col").limit(most)
    return _laid(rows, F.concat(F.lit("  "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit("  "), "kind"), "path", "line", "col")


def formatters_text(runs: DataFrame) -> DataFrame:
    """A line for each formatter run (seq, tool, status, exit_code, check), and whether all passed."""
    detail = F.when(F.col("status") == "ok", F.when(F.col("check"), "(check)").otherwise("")).otherwise(F.concat(F.when(F.col("check"), "check").otherwise("format"), F.lit(" exited "), F.col("exit_code").cast("string")))
    row = F.concat(F.when(F.col("status") == "ok", "  ✅ ").otherwise("  ❌ "), F.rpad("tool", 12, " "), F.lit(" "), detail)
    head = F.concat(F.lit("fmt:\n"), F.when(F.col("report") != "", F.concat("report", F.lit("\n"))).otherwise(""), F.lit("\n"))
    verdict = F.when(F.col("ok"), "  ✅ All formatters passed").otherwise("  ❌ Some formatters failed")
    laid = _laid(runs, row, "seq").withColumn("ok", runs.agg(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True))).scalar())
    return laid.select(F.concat(head, verdict).alias("report"))


def tree_text(files: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """The folders of a file set down to a depth and the files in them, in order, each level two spaces further in."""
    rows = path_tree(files, depth + 1).where(~F.col("is_dir") | (F.col("depth") <= depth))
    parts = F.split("entry", "/")
    line = F.concat(F.expr("repeat('  ', depth)"), F.element_at(parts, -1), F.when(F.col("is_dir"), "/").otherwise(""))
    laid = _laid(rows.withColumn("__o", parts), line, "__o")
    return laid.select(F.concat(F.lit(f"{name}/"), F.when(F.col("report") != "", F.concat(F.lit("\n"), "report")).otherwise("")).alias("report"))


def snapshot_text(snapshot: DataFrame, tree: DataFrame, name: str, date: str, version: str) -> DataFrame:
    """A workspace snapshot (metrics.snapshot) and its tree (tree_text) as Markdown."""
    item = lambda label, value: F.concat(F.lit(f"- **{label}:** "), value.cast("string"))
    quoted = lambda rows: F.transform(rows, lambda x: F.concat(F.lit("  - `"), F.substring(x, 1, 80), F.lit("`")))
    listed = lambda label, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(label)), quoted(rows))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.lit(f"# Snapshot: {name}"), F.lit(f"**Date:** {date}"), F.lit(f"**Tool:** snapshot v{version}"), F.lit(""), F.lit("## Git")),
        F.array(item("Branch", F.col("branch")), item("Commit", F.col("commit")), item("Message", F.col("subject")), item("Dirty files", F.col("n_changed"))),
        listed("- Changes:", F.slice("changed", 1, 20)),
        listed("- Recent commits:", F.col("recent")),
        F.array(F.lit(""), F.lit("## Files"), item("Total files", F.col("total_files")), item("Total lines", F.col("total_lines")), F.lit("- By extension:")),
        F.transform("by_ext", lambda e: F.concat(F.lit("  - `"), e["ext"], F.lit("`: "), e["files"].cast("string"))),
        F.array(F.lit(""), F.lit("## Directory Tree"), F.col("tree"), F.lit("")),
    )
    return snapshot.withColumn("tree", tree.select("report").scalar()).select(F.array_join(lines, "\n").alias("report"))
