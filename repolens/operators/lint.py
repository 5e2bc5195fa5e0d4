"""Output of linters, type checkers and test runs, parsed into issues and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import java

# Line formats in the order in which the first match counts, with the group of each field.
FORMATS = (
    ("ruff", r"^(.+?):(\d+):(\d+):\s+(\w+)\s+(.+)$", {"file": 1, "line": 2, "col": 3, "severity": 4, "message": 5}),
    ("eslint", r"^(.+?):(\d+):(\d+):\s+(warning|error)\s+(.+)$", {"file": 1, "line": 2, "col": 3, "severity": 4, "message": 5}),
    ("tsc", r"^(.+)\((\d+),(\d+)\):\s+(error|warning)\s+(.+)$", {"file": 1, "line": 2, "col": 3, "severity": 4, "message": 5}),
    ("mypy", r"^(.+?):(\d+):\s+(error|warning|note):\s+(.+)$", {"file": 1, "line": 2, "severity": 3, "message": 4}),
    ("pylint", r"^(.+?):(\d+):(\d+):\s+(\w\d+):\s+(.+)$", {"file": 1, "line": 2, "col": 3, "severity": 4, "message": 5}),
    ("generic", r"^(.+?):(\d+):\s+(.+)$", {"file": 1, "line": 2, "message": 3}),
)
_BLOCK = r"^\s*(\d+):(\d+)\s+(warning|error)\s+(.+?)\s+(?:\S+(?:/\S+)?)?\s*$"
_SPACE = " \t\n\x0b\x0c\r"


_FIELDS = ("file", "line", "col", "severity", "message")
_CUT = "\x1f"


def parse_lines(output: DataFrame, column: str = "text") -> DataFrame:
    """All other columns, and parser, file, line, col, severity, message, by the first format that a line matches.

    The patterns cover a whole line, so one replacement lays its fields side by side behind the parser's name;
    the unit separator (U+001F) stands between them, and in the line itself counts as a blank.
    """
    rest = [c for c in output.columns if c not in (column, "parser", *_FIELDS)]
    text = F.translate(F.btrim(F.col(column), F.lit(_SPACE)), _CUT, " ")
    laid = F.lit(None).cast("string")
    for name, pattern, fields in reversed(FORMATS):
        shape = _CUT.join([name, *(f"${fields[f]}" if f in fields else "" for f in _FIELDS)])
        laid = F.when(text.rlike(java(pattern)), F.regexp_replace(text, java(pattern), shape)).otherwise(laid)
    # the generator holds the expression in one place: a projection would repeat it for each field
    parts = output.select(*rest, F.explode(F.array_compact(F.array(laid))).alias("__laid")).select(*rest, F.split("__laid", _CUT).alias("__p"))
    get = lambda f: F.nullif(F.col("__p")[1 + _FIELDS.index(f)], F.lit("")) if f in ("line", "col", "severity") else F.col("__p")[1 + _FIELDS.index(f)]
    return parts.select(*rest, F.col("__p")[0].alias("parser"), get("file").alias("file"), get("line").cast("int").alias("line"), get("col").cast("int").alias("col"), get("severity").alias("severity"), get("message").alias("message"))


def parse_blocks(output: DataFrame, column: str = "text", run: str = "run", number: str = "line_no") -> DataFrame:
    """Issues of outputs that name a file on one line and its problems on the lines below.

    output: (run, line_no, text). A drive is a letter and a colon, so 3:7 begins a problem. The file is carried forward to the problems of the same run.
    """
    raw = F.col(column)
    text = F.btrim(raw, F.lit(_SPACE))
    drive = text.rlike("^[A-Za-z]:.")
    is_file = (text != "") & (~text.contains(":") | drive) & (text.contains("\\") | text.startswith("/") | drive)
    by = Window.partitionBy(run).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    carried = output.withColumn("__file", F.last(F.when(is_file, text), ignorenulls=True).over(by)).where((text != "") & ~is_file & raw.rlike(java(_BLOCK)) & F.col("__file").isNotNull())
    get = lambda g: F.regexp_extract(raw, java(_BLOCK), g)
    return carried.select(
        run, number, F.lit("eslint").alias("parser"), F.col("__file").alias("file"), get(1).cast("int").alias("line"), get(2).cast("int").alias("col"), get(3).alias("severity"), F.btrim(get(4), F.lit(_SPACE)).alias("message")
    )


def parse_output(output: DataFrame, run: str = "run", number: str = "line_no") -> DataFrame:
    """Line formats; for runs in which none matches, block formats."""
    lines = parse_lines(output.select(run, number, "text"))
    silent = output.join(lines.select(run).distinct(), run, "left_anti")
    return lines.unionByName(parse_blocks(silent, run=run, number=number))


def level(severity: Column | str = "severity") -> Column:
    """error, warning or info."""
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.when(s.isin("error", "E"), "error").when(s.isin("warning", "W"), "warning").otherwise("info")


def by_level(issues: DataFrame) -> DataFrame:
    return issues.groupBy(level().alias("level")).agg(F.count("*").alias("n"))


def shown(issues: DataFrame, *order: str, most: int = 30) -> DataFrame:
    """Errors, then warnings, then the rest, each in the given order; the first 30."""
    place = F.array_position(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), level())
    return issues.orderBy(place, *order).limit(most)


def _number(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(text, java(pattern), 1).try_cast("int"), F.lit(0))


def tool_totals(outputs: DataFrame, text: str = "output") -> DataFrame:
    """All columns, and passed, failed, errors, total of test runs, and issues of type checkers and linters."""
    t = F.col(text)
    out = outputs.withColumns({"passed": _number(t, r"(\d+) passed"), "failed": _number(t, r"(\d+) failed"), "errors": _number(t, r"(\d+) errors?\b"), "issues": F.greatest(_number(t, r"Found (\d+) errors?"), _number(t, r"(\d+) errors? in \d+ files?"))})
    return out.withColumn("total", F.col("passed") + F.col("failed") + F.col("errors"))
