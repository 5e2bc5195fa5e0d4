"""Definitions that nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import java
from .symbols import blanked

# Names that are never reported.
TEST_LIFECYCLE = ("setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule")
TS_ENTRY = ("main", "exports", "default", "handler")

_TS_FUNCTION = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)|(?:export\s+)?(?:const\s+)(\w+)\s*=\s*(?:async\s+)?(?:\(|function)"
_TS_CLASS = r"(?:export\s+)?class\s+(\w+)"


def reportable(name: Column) -> Column:
    """Not private, not a test or its lifecycle, not main. Dunder names are called by the language."""
    private = name.startswith("_")
    return ~(private | name.isin(*TEST_LIFECYCLE, "main") | name.startswith("test_") | name.startswith("Test"))


def unused(definitions: DataFrame, references: DataFrame, least: int = 1, keys: tuple[str, ...] = ("path", "name")) -> DataFrame:
    """(keys, kind, definitions, references): definitions with fewer than ``least`` references.

    definitions: (path, name, kind); references: (path, name). keys without path count the whole project.
    """
    counted = references.groupBy(*keys).agg(F.count("*").alias("references"))
    defs = definitions.groupBy(*keys).agg(F.max("kind").alias("kind"), F.count("*").alias("definitions"))
    joined = defs.join(counted, list(keys), "left").withColumn("references", F.coalesce("references", F.lit(0)))
    return joined.where(F.col("references") < least).select(*keys, "kind", "definitions", "references")


def unused_python(facts: DataFrame, least: int = 1, project: bool = False) -> DataFrame:
    """Unused functions and classes from the facts of Python files; per file, or with project=True over all."""
    defs = facts.where((F.col("fact") == "def") & F.col("kind").isin("function", "async_function", "class") & reportable(F.col("name")))
    defs = defs.select("path", "name", F.when(F.col("kind") == "class", "class").otherwise("function").alias("kind"))
    refs = facts.where((F.col("fact") == "ref") & F.col("kind").isin("load", "attribute")).select("path", "name")
    return unused(defs, refs, least, ("name",) if project else ("path", "name"))


def unused_typescript(files: DataFrame, least: int = 1) -> DataFrame:
    """Unused functions and classes of TypeScript files; a definition is no reference to itself."""
    clear = files.where(F.col("lang") == "ts").select("path", blanked(F.col("content")).alias("c"))
    every = lambda p, g: F.regexp_extract_all("c", F.lit(java(p)), g)
    named = F.filter(F.concat(every(_TS_FUNCTION, 1), every(_TS_FUNCTION, 2)), lambda x: x != "")
    both = F.concat(F.transform(named, lambda x: F.struct(x.alias("name"), F.lit("function").alias("kind"))), F.transform(every(_TS_CLASS, 1), lambda x: F.struct(x.alias("name"), F.lit("class").alias("kind"))))
    defs = clear.select("path", F.explode(both).alias("d")).select("path", "d.*").where(~F.col("name").isin(*TS_ENTRY))
    without = F.regexp_replace("c", java(r"(?:function|class|const|let|var)\s+\w+"), " ")
    words = F.regexp_extract_all(without, F.lit(java(r"(?<![.\w])(\w+)(?=\s*[\(,;:)\]={}.<])|\bnew\s+(\w+)|\bextends\s+(\w+)")), 0)
    refs = clear.select("path", F.explode(F.transform(words, lambda w: F.regexp_extract(w, r"(?:new\s+|extends\s+)?(.*)", 1))).alias("name"))
    return unused(defs, refs, least)
