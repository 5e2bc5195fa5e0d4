"""Python sources: definitions, references, calls and scopes from the syntax tree.

Syntax trees have no SQL form, so a table function in Python parses each file once and yields every fact about
it; definitions, references, callees and scopes are filters on that one table.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.workers import importable

FACTS = "fact string, kind string, name string, line int, end_line int, scope string, depth int, col int"


#: Kinds of the targets of an assignment after its first one; late: the first that is a name.
MORE_TARGETS = ("variable_late", "variable_more")


def facts_of(source: str | None) -> list[tuple]:
    """Rows (fact, kind, name, line, end_line, scope, depth, col) of a source; none if it does not parse.

    fact: def, import, ref, call or scope. scope: the innermost function, else class, around it. Columns count
    characters from 0.
    """
    try:
        parsed = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = (source or "").split("\n")
    wide = {i: line.encode() for i, line in enumerate(lines, 1) if not line.isascii()}
    rows: list[tuple] = []

    def column(node) -> int:
        line = wide.get(node.lineno)
        return node.col_offset if line is None else len(line[: node.col_offset].decode("utf-8", "replace"))

    def name_column(node, name: str) -> int:
        line = lines[node.lineno - 1]
        at = column(node)
        words = ("async", "def", "class")
        for part in line[at:].split():
            if part not in words:
                break
            at = line.index(part, at) + len(part)
        return line.find(name, at)

    # an explicit stack: long sums and chains of calls are deeper than Python may recurse
    todo: list[tuple] = [(parsed, "", 0, False)]
    while todo:
        node, scope, depth, in_function = todo.pop()
        inner, deeper, within = scope, depth, in_function
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
            rows.append(("def", kind, node.name, node.lineno, node.end_lineno, scope, depth, name_column(node, node.name)))
            rows.append(("scope", "class" if is_class else "function", node.name, node.lineno, node.end_lineno, scope, depth, 0))
            deeper = depth + 1
            inner = node.name if not is_class or not in_function else scope
            within = in_function or not is_class
        elif isinstance(node, ast.Assign):
            named = [i for i, target in enumerate(node.targets) if isinstance(target, ast.Name)]
            for i in named:
                target = node.targets[i]
                rows.append(("def", "variable" if i == 0 else "variable_late" if i == named[0] else "variable_more", target.id, node.lineno, node.end_lineno, scope, depth, column(target)))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for alias in node.names:
                rows.append(("import", "import", alias.asname or alias.name.split(".")[0], node.lineno, node.end_lineno, scope, depth, column(alias)))
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                rows.append(("call", "call", f.id, node.lineno, node.end_lineno, scope, depth, column(f)))
            elif isinstance(f, ast.Attribute):
                full = f"{f.value.id}.{f.attr}" if isinstance(f.value, ast.Name) else f.attr
                rows.append(("call", "attribute", full, node.lineno, node.end_lineno, scope, depth, column(f)))
        if isinstance(node, ast.Name):
            rows.append(("ref", "load" if isinstance(node.ctx, ast.Load) else "store", node.id, node.lineno, node.end_lineno, scope, depth, column(node)))
        elif isinstance(node, ast.Attribute):
            rows.append(("ref", "attribute" if isinstance(node.ctx, ast.Load) else "attribute_store", node.attr, node.end_lineno, node.end_lineno, scope, depth, column(node)))
        todo.extend((child, inner, deeper, within) for child in reversed(list(ast.iter_child_nodes(node))))
    return rows


@udtf(returnType=FACTS)
class PyFacts:
    """SELECT * FROM files, LATERAL py_facts(content)"""

    def eval(self, source: str):
        yield from facts_of(source)


def register(spark) -> None:
    importable(spark)
    spark.udtf.register("py_facts", PyFacts)


def facts(files: DataFrame) -> DataFrame:
    """(path, fact, kind, name, line, end_line, scope, depth, col) of the Python files of a set."""
    importable(files.sparkSession)
    return files.where(F.col("lang") == "py").select("path", "content").lateralJoin(PyFacts(F.col("content").outer())).drop("content")


def tags(found: DataFrame) -> DataFrame:
    """(path, name, kind, line): functions, classes, every assigned name, imports."""
    kind = F.when(F.col("kind") == "async_function", "function").when(F.col("kind").startswith("variable"), "variable").otherwise(F.col("kind"))
    return found.where(F.col("fact").isin("def", "import")).select("path", "name", kind.alias("kind"), "line")


def all_definitions(found: DataFrame) -> DataFrame:
    """(path, type, name, line): functions, classes, the first name that each assignment binds, and imported names."""
    kept = found.where((F.col("fact") == "import") | ((F.col("fact") == "def") & (F.col("kind") != "variable_more")))
    return tags(kept).select("path", F.col("kind").alias("type"), "name", "line")


def definitions(found: DataFrame, symbol: str) -> DataFrame:
    """(path, type, name, line); of several targets of an assignment only the first counts."""
    return found.where((F.col("fact") == "def") & ~F.col("kind").isin(*MORE_TARGETS) & (F.col("name") == symbol)).select("path", F.col("kind").alias("type"), "name", "line")


def references(found: DataFrame, symbol: str) -> DataFrame:
    """(path, type, line): calls, attributes, imports, and plain names on lines without a call or definition of it."""
    mine = found.where((F.col("name") == symbol) | ((F.col("fact") == "call") & F.col("name").endswith("." + symbol)))
    fact, kind = F.col("fact"), F.col("kind")
    flag = lambda condition, name: F.max(condition).alias(name)
    lines = mine.groupBy("path", "line").agg(
        flag(fact == "call", "called"),
        flag((fact == "call") & (kind == "call"), "called_plainly"),
        flag((fact == "def") & ~kind.startswith("variable"), "defined"),
        flag((fact == "ref") & kind.isin("load", "store"), "named"),
        flag((fact == "ref") & kind.startswith("attribute"), "attribute"),
        flag(fact == "import", "imported"),
    )
    types = F.array_compact(
        F.array(
            F.when(F.col("called") & ~F.col("attribute"), "call"),
            F.when(F.col("named") & ~F.col("called_plainly") & ~F.col("defined"), "reference"),
            F.when(F.col("attribute"), "attribute"),
            F.when(F.col("imported"), "import"),
        )
    )
    return lines.select("path", F.explode(types).alias("type"), "line")


def calls(found: DataFrame) -> DataFrame:
    """(path, scope, callee, line) of calls inside functions; nested functions own theirs."""
    return found.where((F.col("fact") == "call") & (F.col("scope") != "")).select("path", "scope", F.col("name").alias("callee"), "line")


def scopes(found: DataFrame) -> DataFrame:
    """(path, name, kind, start, end, depth)"""
    return found.where(F.col("fact") == "scope").select("path", "name", "kind", F.col("line").alias("start"), F.col("end_line").alias("end"), "depth")


def rename_spans(found: DataFrame, symbol: str) -> DataFrame:
    """(path, line, col, kind) of the names that a rename touches: definitions, names, imports; not attributes."""
    kinds = (F.col("fact") == "def") & F.col("kind").isin("function", "async_function", "class") | (F.col("fact") == "import") | ((F.col("fact") == "ref") & F.col("kind").isin("load", "store"))
    kind = F.when(F.col("fact") == "def", "definition").when(F.col("fact") == "import", "import").otherwise("reference")
    return found.where(kinds & (F.col("name") == symbol) & (F.col("col") >= 0)).select("path", "line", "col", kind.alias("kind")).distinct()
