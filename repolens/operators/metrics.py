"""Counts of files and lines, workspace snapshots, and reports over metrics and tool runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import newline_count, shown_lines


def by_language(files: DataFrame) -> DataFrame:
    """(lang, files, lines); lines as iterating over a file counts them."""
    return files.groupBy("lang").agg(F.count("*").alias("files"), F.sum(shown_lines("content")).alias("lines"))


def by_extension(files: DataFrame) -> DataFrame:
    """(ext, files, newlines), the commonest first."""
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum(newline_count("content")).alias("newlines")).orderBy(F.desc("files"), "ext")


def snapshot(scanned: DataFrame, workspace: DataFrame) -> DataFrame:
    """One row: the workspace's columns, total_files, total_lines and by_ext, an array of (ext, files), commonest first.

    scanned: (path, ext, lines) of all files. Extensions are pre-aggregated; only their counts meet in a row.
    """
    by_ext = scanned.groupBy("ext").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    total = by_ext.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("files")).alias("n"), "ext"))), lambda e: F.struct(e["ext"].alias("ext"), (-e["n"]).alias("files"))).alias("by_ext"),
    )
    # a scalar subquery: the workspace is one row
    own = workspace.select(F.struct(*workspace.columns)).scalar()
    return total.withColumn("__w", own).select("__w.*", *total.columns)


def split_line_count(content: str = "content") -> Column:
    """Lines between newlines: one more than by_language() counts if the text ends with one."""
    return F.size(F.split(content, "\n", -1))


def metric(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One row (metric, value) from an aggregate."""
    return df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gate(results: DataFrame) -> DataFrame:
    """One row: tools, ok (all of them) and elapsed of tool runs (tool, status, elapsed)."""
    return results.agg(F.count("*").alias("tools"), F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("ok"), F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("elapsed"))


def exit_code(ok: Column) -> Column:
    """0 if all is well, else 1."""
    return F.when(ok, 0).otherwise(1)


def duration(seconds: Column) -> Column:
    """45s, or 2m 5s."""
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.concat((F.floor(whole / 60)).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def markdown(results: DataFrame, title: str = "Report") -> str:
    """A report of tool runs (tool, status, elapsed) as Markdown; one row for each tool comes to the driver."""
    rows = results.select("tool", "status", duration(F.col("elapsed")).alias("took")).orderBy("tool").collect()
    total = gate(results).first()
    head = [f"# {title}", "", f"Overall: {'ok' if total['ok'] else 'failing'}", "", "| tool | status | time |", "| --- | --- | --- |"]
    return "\n".join([*head, *(f"| {r['tool']} | {r['status']} | {r['took']} |" for r in rows)]) + "\n"


def call_tree(rows: list[tuple[int, str, bool]]) -> str:
    """Preorder rows (depth, name, cycle) drawn with box characters."""
    out = []
    for i, (depth, name, cycle) in enumerate(rows):
        later = next((d for d, _, _ in rows[i + 1 :] if d <= depth), -1)
        stem = "" if depth == 0 else "    " * (depth - 1) + ("├── " if later == depth else "└── ")
        out.append(stem + name + (" (cycle)" if cycle else ""))
    return "\n".join(out)
