"""Symbols of C++ and TypeScript sources by patterns, the symbol index, and symbols at a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import java
from ..functions.text import first_by, matches_of, with_lines

# What symbols look like, with the kind of each.
CPP_TAGS = (
    (r"(?:class|struct)\s+(\w+)", "class"),
    (r"(?:enum|union)\s+(\w+)", "enum"),
    (r"(?:void|int|bool|char|float|double|size_t|auto|const\s+\w+[\s*&]+)\s*[*&]?\s*\b(\w+)\s*\(", "function"),
    (r"(\w+)\s*::\s*(\w+)\s*\(", "method"),
    (r"#define\s+(\w+)", "macro"),
    (r"using\s+(\w+)\s*=", "typealias"),
    (r"typedef\s+.*\s+(\w+);", "typedef"),
)
TS_TAGS = (
    (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
    (r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "class"),
    (r"(?:export\s+)?interface\s+(\w+)", "interface"),
    (r"(?:export\s+)?type\s+(\w+)\s*=", "typealias"),
    (r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "enum"),
    (r"(?:export\s+)?const\s+(\w+)\s*(?::[^=;]+)?\s*=", "variable"),
    (r"(?:export\s+)?let\s+(\w+)\s*(?::[^=;]+)?\s*=", "variable"),
    (r"(?:export\s+)?var\s+(\w+)\s*(?::[^=;]+)?\s*=", "variable"),
    (r"(?:export\s+)?default\s+(?:function|class)\s+(\w+)", "default_export"),
    (r"@\w+\s*\n\s*(?:export\s+)?(?:class|function)\s+(\w+)", "decorated"),
)
CPP_DEFINITIONS = (
    (r"(?:\w[\w:<>*&]*\s+)?(\w+)\s*\([^;{]*\)\s*(?:const|override)?\s*\{", "function"),
    (r"(?:\w[\w:<>*&]+\s+)(\w+)\s*\([^;{]*\)\s*(?:const|override)?\s*;", "function_decl"),
    (r"(?:\w[\w:<>*&]+\s+)([a-z_]\w*)\s*(?:=)", "variable"),
    (r"(?:\w[\w:<>*&]+\s+)([a-z_]\w*)\s*;", "variable_decl"),
    (r"(\w+)\s*::\s*(\w+)\s*\(", "method"),
    (r"(?:class|struct)\s+(\w+)(?:\s*:\s*public\s+\w+)?\s*\{", "class"),
    (r"#define\s+(\w+)", "macro"),
)
TS_DEFINITIONS = (
    (r"(?:export[ \t]+)?(?:async[ \t]+)?function[ \t]+(?:\*[ \t]+)?(\w+)", "function"),
    (r"(?:export[ \t]+)?(?:const|let|var)[ \t]+(\w+)[ \t]*=[ \t]*(?:async[ \t]+)?(?:\([^)]*\)|\w+)[ \t]*=>", "arrow_function"),
    (r"(?:export[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(\w+)", "class"),
    (r"(?:export[ \t]+)?interface[ \t]+(\w+)", "interface"),
    (r"(?:export[ \t]+)?type[ \t]+(\w+)[ \t]*=", "type_alias"),
    (r"(?:export[ \t]+)?(?:const[ \t]+)?enum[ \t]+(\w+)", "enum"),
    (r"(?:export[ \t]+)?(?:const|let|var)[ \t]+(\w+)[ \t]*(?::[^=;]+)?[ \t]*=(?!=)[ \t]*(?![ \t]*(?:\([^)]*\)|\w+)[ \t]*=>)", "variable"),
    (r"(?:public|private|protected)?[ \t]*(constructor)[ \t]*\(", "constructor"),
    (r"(?m)^[ \t]*(?:public|private|protected|static|readonly|async)[ \t]+(?:get[ \t]+|set[ \t]+)?(\w+)[ \t]*\([^)]*\)[ \t]*(?::[^{]+)?[ \t]*\{", "method"),
    (r"export[ \t]+default[ \t]+(?:(?:function|class)[ \t]+)?(\w+)", "default_export"),
    (r"@\w+[ \t]*\n[ \t]*(?:export[ \t]+)?(?:class|function)[ \t]+(\w+)", "decorated"),
)
# Words that no call, or no identifier, can be.
CALL_KEYWORDS = ("if", "for", "while", "return", "switch", "catch", "elif", "except", "with", "yield", "raise", "del", "assert", "try", "typeof", "instanceof", "void", "delete")
KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally",
    "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
)


def by_rules(files: DataFrame, rules, name_group=lambda kind: 1) -> DataFrame:
    """(path, name, kind, line, rule): matches of each rule over whole texts, in one pass over the files.

    rule: its place in the table.
    """
    table = [(java(pattern), name_group(kind), kind) for pattern, kind in rules]
    found = matches_of(files.select("path", "content"), [(pattern, g) for pattern, g, _ in table])
    kinds = F.array(*(F.lit(kind) for _, _, kind in table))
    return found.select("path", F.col("g").alias("name"), kinds[F.col("rule")].alias("kind"), F.col("line_no").alias("line"), "rule")


def cpp_tags(files: DataFrame) -> DataFrame:
    return by_rules(files.where(F.col("lang") == "cpp"), CPP_TAGS)


def ts_tags(files: DataFrame) -> DataFrame:
    return by_rules(files.where(F.col("lang") == "ts"), TS_TAGS)


def cpp_definitions(files: DataFrame) -> DataFrame:
    """(path, type, name, line); of qualified methods the name is the part after the colons."""
    found = by_rules(files.where(F.col("lang") == "cpp"), CPP_DEFINITIONS, lambda kind: 2 if kind == "method" else 1)
    return found.select("path", F.col("kind").alias("type"), "name", "line", "rule")


def blanked(content: Column) -> Column:
    """TypeScript without strings and comments; every newline stays where it is."""
    spaces = lambda text, pattern: F.array_join(F.transform(F.split(F.regexp_replace(text, pattern, "\x02$0\x02"), "\x02", -1), lambda part, i: F.when(i % 2 == 1, F.regexp_replace(part, "[^\n]", " ")).otherwise(part)), "")
    return spaces(content, r"""'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\[\s\S]|[^`\\])*`|//[^\n]*|/\*[\s\S]*?\*/""")


def ts_definitions(files: DataFrame) -> DataFrame:
    """(path, type, name, line) on blanked text; the first rule that names a symbol on a line wins."""
    clear = files.where(F.col("lang") == "ts").select("path", "lang", blanked(F.col("content")).alias("content"))
    found = by_rules(clear, TS_DEFINITIONS)
    return first_by(found, ["path", "name", "line"], [F.col("rule")]).select("path", F.col("kind").alias("type"), "name", "line", "rule")


def index_stats(tags: DataFrame, group: str = "kind", other: str = "lang") -> DataFrame:
    """(kind, lang, total_tags, total_symbols): by kind, by language and in all, in one pass."""
    return tags.groupingSets([[group], [other], []], group, other).agg(F.count("*").alias("total_tags"), F.countDistinct("name").alias("total_symbols"))


def lookup(tags: DataFrame, symbol: str) -> DataFrame:
    return tags.where(F.col("name") == symbol)


def infer(files: DataFrame) -> DataFrame:
    """(path, line_no, symbol) for every line: what a pointer at that line most likely means.

    A call on the line, a definition, an assignment; else the nearest definition above; else the first word,
    unless it is a keyword.
    """
    line = F.col("line")
    pick = lambda p: F.nullif(F.regexp_extract(line, java(p), 1), F.lit(""))
    call = pick(r"([A-Za-z_]\w*)\s*\(")
    above = pick(r"^\s*(?:def|class|function|interface|type|enum|async\s+def|export\s+default)\s+(\w+)")
    lines = with_lines(files.select("path", "content"))
    upward = F.last(above, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    word = pick(r"(\w+)")
    symbol = F.coalesce(
        F.when(~call.isin(*CALL_KEYWORDS), call),
        pick(r"^\s*(?:def|class|function|interface|type|enum)\s+(\w+)"),
        pick(r"^\s*(?:const|let|var)?\s*(\w+)\s*(?::[^=;]+)?\s*="),
        upward,
        F.when(~word.isin(*KEYWORDS), word),
    )
    return lines.select("path", "line_no", symbol.alias("symbol"))
