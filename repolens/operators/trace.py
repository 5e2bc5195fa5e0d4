"""Enclosing scopes, callers and callees, and the impact of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import first_by
from ..functions.workers import importable
from ..sources.files import is_test
from . import pysyntax, symbols
from .graph import checkpointed
from .search import tokens, word_references

# Words before a parenthesis that are no C++ functions.
CPP_NOT_CALLED = (
    "if", "for", "while", "switch", "catch", "return", "sizeof", "new", "delete", "throw", "else", "do", "case", "static_cast",
    "dynamic_cast", "reinterpret_cast", "const_cast", "alignof", "decltype", "typeid",
)


# A C++ function with a body, and a call.
CPP_FUNCTION = r"(?:\w[\w:<>*&]*\s+)?(\w+)\s*\([^;{]*\)\s*(?:const|override)?\s*\{"
CPP_CALL = r"(\w+)\s*\("


def brace_rows(source: str | None) -> list[tuple]:
    """(row, name, line, end_line): functions with bodies, by matching braces, and the calls inside them."""
    import re

    text = source or ""
    rows = []
    starts = [i for i, c in enumerate(text) if c == "\n"]
    from bisect import bisect_left

    line_of = lambda at: bisect_left(starts, at) + 1
    bodies = []
    for m in re.finditer(CPP_FUNCTION, text):
        if m[1] in CPP_NOT_CALLED:
            continue
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        rows.append(("scope", m[1], line_of(m.end() - 1), line_of(at - 1)))
        bodies.append((m.end(), at, m[1]))
    for low, high, name in bodies:
        for m in re.finditer(CPP_CALL, text[low:high]):
            at = low + m.start()
            inner = any(low < a <= at < b <= high for a, b, _ in bodies if (a, b) != (low, high))
            if m[1] not in CPP_NOT_CALLED and not m[1][0].isdigit() and not inner:
                rows.append((f"call:{m[1]}", name, line_of(at), line_of(at)))
    return rows


@udtf(returnType="row string, name string, line int, end_line int")
class CppBlocks:
    def eval(self, source: str):
        yield from brace_rows(source)


def cpp_blocks(files: DataFrame) -> DataFrame:
    """(path, row, name, line, end_line) of the C++ files: scopes, and call:NAME rows inside them."""
    importable(files.sparkSession)
    return files.where(F.col("lang") == "cpp").select("path", "content").lateralJoin(CppBlocks(F.col("content").outer())).drop("content")


def cpp_scopes(blocks: DataFrame) -> DataFrame:
    return blocks.where("row = 'scope'").select("path", "name", F.lit("function").alias("kind"), F.col("line").alias("start"), F.col("end_line").alias("end"), F.lit(0).alias("depth"))


def cpp_calls(blocks: DataFrame) -> DataFrame:
    return blocks.where("row LIKE 'call:%'").select("path", F.col("name").alias("scope"), F.substring("row", 6, 1 << 30).alias("callee"), "line")


def enclosing(occurrences: DataFrame, scopes: DataFrame, innermost: bool = True, at: str = "line_no") -> DataFrame:
    """Occurrences with the scope (name) around them, null at module level.

    An equality on path makes the interval join a hash join with a residual. Functions go before classes; of
    several the innermost counts, or with innermost=False the one that begins first. Equal occurrences meet the
    scopes once and come back as often as they were.
    """
    counted = occurrences.groupBy(*occurrences.columns).agg(F.count("*").alias("__times"))
    o, s = counted.alias("o"), scopes.alias("s")
    hit = (F.col("o.path") == F.col("s.path")) & F.col(f"o.{at}").between(F.col("s.start"), F.col("s.end"))
    size = F.col("s.end") - F.col("s.start")
    order = F.struct((F.col("s.kind") == "class").cast("int"), (size if innermost else F.col("s.start")), F.col("s.start") if not innermost else -F.col("s.start"))
    keys = [F.col(f"o.{c}") for c in counted.columns]
    placed = o.join(s, hit, "left").groupBy(*keys).agg(F.min_by("s.name", order).alias("scope"))
    return placed.select(*occurrences.columns, "scope", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int"))).alias("__copy")).drop("__copy")


def occurrences(files: DataFrame) -> DataFrame:
    """(symbol, path, line_no): each word once a line."""
    return tokens(files).select(F.col("token").alias("symbol"), "path", "line_no").distinct()


def token_calls(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """(caller, symbol, path, line): every word of every line with the scope around it, "" at module level.

    The index form of a call graph: it needs no syntax beyond scopes, so it serves every language.
    """
    placed = enclosing(occurrences(files), scopes)
    return placed.select(F.coalesce("scope", F.lit("")).alias("caller"), "symbol", "path", F.col("line_no").alias("line")).where("caller != symbol")


def callers(calls: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, depth, caller, symbol): breadth-first upward from symbols; every caller once, at its least depth.

    calls: (caller, symbol); roots: (root). Eager: each level is one join and one anti join.
    """
    edges = calls.select("caller", "symbol").where("caller != symbol").distinct()
    frontier = roots.select("root", F.col("root").alias("symbol"))
    seen = frontier.select("root", F.col("symbol").alias("caller"))
    out = None
    for d in range(1, depth + 1):
        step = first_by(frontier.join(edges, "symbol"), ["root", "caller"], [F.col("symbol")]).join(seen, ["root", "caller"], "left_anti")
        level = checkpointed(step.select("root", F.lit(d).alias("depth"), "caller", "symbol"))
        out = level if out is None else out.unionByName(level)
        seen = seen.unionByName(level.select("root", "caller"))
        frontier = level.select("root", F.col("caller").alias("symbol"))
    return out


def callees(calls: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, depth, symbol, callees): breadth-first downward; callees: sorted distinct names, comma-joined.

    calls: (caller, symbol). A symbol is expanded once, at its least depth.
    """
    edges = calls.select("caller", "symbol").distinct()
    flipped = edges.select(F.col("symbol").alias("caller"), F.col("caller").alias("symbol"))
    start = roots.select("root", F.lit(0).alias("depth"), F.col("root").alias("symbol"))
    reached = start if depth < 2 else start.unionByName(callers(flipped, roots, depth - 1).select("root", "depth", F.col("caller").alias("symbol")))
    expanded = reached.join(edges.select(F.col("caller").alias("symbol"), F.col("symbol").alias("callee")), "symbol")
    return expanded.groupBy("root", "depth", "symbol").agg(F.array_join(F.sort_array(F.collect_set("callee")), ",").alias("callees"))


def outside_nested(calls: DataFrame, scopes: DataFrame, symbol: str) -> DataFrame:
    """Calls within a symbol's scopes but in none of the scopes nested in them."""
    own = scopes.where(F.col("name") == symbol).select("path", "start", "end")
    inside = calls.alias("c").join(own.alias("o"), (F.col("c.path") == F.col("o.path")) & F.col("c.line").between(F.col("o.start"), F.col("o.end"))).select("c.*", F.col("o.start").alias("from"), F.col("o.end").alias("to"))
    nested = scopes.alias("n")
    within = (F.col("c.path") == F.col("n.path")) & F.col("c.line").between(F.col("n.start"), F.col("n.end")) & (F.col("n.start") > F.col("c.from")) & (F.col("n.end") <= F.col("c.to"))
    return inside.alias("c").join(nested, within, "left_anti").select(*calls.columns).distinct()


def impact(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """(section, path, line, type): definitions, references elsewhere, and references in tests, each once.

    definitions, references: (path, type, line).
    """
    defs = first_by(definitions, ["path", "line", "type"], [F.col("type")])
    refs = first_by(references, ["path", "line"], [F.col("type")])
    elsewhere = refs.join(defs.select("path", "line").distinct(), ["path", "line"], "left_anti")
    part = lambda df, name: df.select(F.lit(name).alias("section"), "path", "line", "type")
    return part(defs, "definition").unionByName(part(elsewhere, "reference")).unionByName(part(refs.where(is_test("path")), "test"))


def definitions_in(files: DataFrame, symbol: str | None = None) -> DataFrame:
    """(path, type, name, line): definitions of all languages, of one symbol or of all, each once."""
    py = pysyntax.facts(files).where((F.col("fact") == "def") & ~F.col("kind").isin(*pysyntax.MORE_TARGETS)).select("path", F.col("kind").alias("type"), "name", "line")
    other = symbols.cpp_definitions(files).unionByName(symbols.ts_definitions(files)).select("path", "type", "name", "line")
    found = py.unionByName(other)
    found = found if symbol is None else found.where(F.col("name") == symbol)
    return first_by(found, ["path", "name", "line"], [F.col("type")])


def all_definitions_in(files: DataFrame) -> DataFrame:
    """(path, type, name, line): what files define, imports of Python files included.

    In C++ and TypeScript a name counts once a line, under its first rule; in Python every row stays.
    """
    other = symbols.cpp_definitions(files).unionByName(symbols.ts_definitions(files))
    other = first_by(other, ["path", "name", "line"], [F.col("rule")]).select("path", "type", "name", "line")
    return pysyntax.all_definitions(pysyntax.facts(files)).unionByName(other)


def references_in(files: DataFrame, symbol: str) -> DataFrame:
    """(path, type, line): from the syntax tree in Python files, whole words elsewhere."""
    py = pysyntax.references(pysyntax.facts(files), symbol)
    words = word_references(files.where("lang != 'py'"), symbol).select("path", "type", F.col("line_no").alias("line"))
    return py.unionByName(words)


def tags_in(files: DataFrame) -> DataFrame:
    """(path, name, kind, line): the symbol index of all languages."""
    other = symbols.cpp_tags(files).unionByName(symbols.ts_tags(files)).select("path", "name", "kind", "line")
    return pysyntax.tags(pysyntax.facts(files)).unionByName(other)


def numbered(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each section, with how many more there are."""
    by = Window.partitionBy("section").orderBy("path", "line", "type")
    ranked = found.withColumn("__n", F.row_number().over(by)).withColumn("more", F.greatest(F.count("*").over(Window.partitionBy("section")) - most, F.lit(0)))
    return ranked.where(F.col("__n") <= most).drop("__n")
