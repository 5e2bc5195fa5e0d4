"""Import graphs: imports, resolution, degrees, trees, cycles and closures.

Edges are (src, dst) and form a bag. Fixpoints loop over DataFrames and cut their lineage with checkpoints in
the cluster's shared folder; bounded trees are unions of joins.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import java
from ..functions.workers import importable
from ..sources.files import SOURCE_EXTS

# Import statements.
PY_IMPORT = r"(?m)^\s*(?:from\s+([.\w]+)\s+)?import\s+(.+)$"
TS_IMPORT = r"""import\s+(?:type\s+)?(?:(?:\{[^}]*\}|\w+(?:\s*,\s*(?:\{[^}]*\}|\w+))?|\*\s+as\s+\w+)\s+from\s+)?['"]([^'"]+)['"]"""
TS_REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
TS_EXPORT = r"""export\s+(?:type\s+)?(?:\{[^}]*\}|(?:\w+\s+)*\w+)\s+from\s+['"]([^'"]+)['"]"""
CPP_INCLUDE = r'#include\s+["<]([^">]+)[">]'
HUB_DEGREE = 5
#: A graph of at most so many nodes, counted first, is closed in pairs, which takes few rounds; a larger one never is.
SMALL_GRAPH = 1000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def py_modules(content: Column) -> Column:
    """Distinct modules of Python imports: those after from, and the first part of every imported name."""
    names = F.transform(F.split(F.array_join(F.regexp_extract_all(content, F.lit(java(PY_IMPORT)), 2), ","), ","), lambda x: F.regexp_extract(x, r"^\s*([^\s.]+)", 1))
    sources = F.regexp_extract_all(content, F.lit(java(PY_IMPORT)), 1)
    return F.array_sort(F.array_distinct(F.filter(F.concat(sources, names), lambda x: x != "")))


def ts_modules(content: Column) -> Column:
    every = lambda p: F.regexp_extract_all(content, F.lit(java(p)), 1)
    return F.array_sort(F.array_distinct(F.concat(every(TS_IMPORT), every(TS_REQUIRE), every(TS_EXPORT))))


def cpp_modules(content: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(java(CPP_INCLUDE)), 1)))


def imports(files: DataFrame) -> DataFrame:
    """(path, ext, module) of each distinct import of a file, by its language."""
    c = F.col("content")
    modules = F.when(F.col("lang") == "py", py_modules(c)).when(F.col("lang") == "ts", ts_modules(c)).when(F.col("lang") == "cpp", cpp_modules(c))
    return files.where(F.col("lang").isin("py", "ts", "cpp")).select("path", "ext", F.explode(modules).alias("module"))


def _join(*parts: Column) -> Column:
    return F.concat_ws("/", *(F.when(p != "", p) for p in parts))


def _normal(path: Column) -> Column:
    """Path without . and .. steps."""
    empty = F.array().cast("array<string>")
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def candidates(found: DataFrame, mode: str = "compat") -> DataFrame:
    """(path, module, ord, candidate): files that an import may mean, in order of preference.

    The importer's extension comes first. Modules that begin with a dot are relative to the importer's folder;
    others are cut at slashes, the longest prefix first. mode="fixed" also reads dotted Python modules as
    paths (leading dots climb), and takes a module that names a file with its extension as it is.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    exts = F.concat(F.array(F.col("ext")), F.filter(F.array(*(F.lit(e) for e in sorted(SOURCE_EXTS))), lambda e: e != F.col("ext")))
    module = F.col("module")
    if mode == "fixed":
        dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
        dotted = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
        climbed = F.concat(F.when(dots > 0, F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))).otherwise(""), dotted)
        module = F.when((F.col("ext") == ".py") & ~module.contains("/"), climbed).otherwise(module)
    with_ext = lambda base: F.concat(F.transform(exts, lambda e: F.concat(base, e)), F.transform(exts, lambda e: F.concat(base, F.lit("/__init__"), e)))
    relative = with_ext(_normal(_join(folder, module)))
    parts = F.split(module, "/")

    def at(i: Column) -> Column:
        prefix, suffix = F.array_join(F.slice(parts, 1, i), "/"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/")
        tail = lambda x: F.when(suffix != "", x)
        return F.flatten(
            F.transform(
                exts,
                lambda e: F.array_compact(
                    F.array(F.concat(prefix, e), tail(F.concat(prefix, F.lit("/"), suffix, e)), F.concat(prefix, F.lit("/__init__"), e), tail(F.concat(prefix, F.lit("/"), suffix, F.lit("/__init__"), e)))
                ),
            )
        )

    absolute = F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), at))
    options = F.when(module.startswith("."), relative).otherwise(absolute)
    if mode == "fixed":
        exact = F.when(module.startswith("."), _normal(_join(folder, module))).otherwise(module)
        beside = _normal(_join(folder, module))
        options = F.concat(options, F.array(exact, beside), F.when(F.col("ext").isin(".py"), with_ext(beside)).otherwise(F.array().cast("array<string>")))
    return found.select("path", "module", F.posexplode(options).alias("ord", "candidate"))


def resolved(found: DataFrame, files: DataFrame, mode: str = "compat") -> DataFrame:
    """(src, dst): each import's first candidate that is a file of the set; a bag of edges."""
    hits = candidates(found, mode).join(files.select(F.col("path").alias("candidate")), "candidate")
    return hits.groupBy("path", "module").agg(F.min_by("candidate", "ord").alias("dst")).select(F.col("path").alias("src"), "dst")


def import_graph(files: DataFrame, mode: str = "compat") -> DataFrame:
    return resolved(imports(files), files, mode)


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "path") -> DataFrame:
    """(node, out_degree, in_degree, role): one aggregation over both ends of the edges."""
    ends = edges.select(F.col("src").alias(node), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias(node), F.lit(0).alias("o"), F.lit(1).alias("i")))
    total = ends.unionByName(nodes.select(node, F.lit(0).alias("o"), F.lit(0).alias("i"))).groupBy(node).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    o, i = F.col("out_degree"), F.col("in_degree")
    role = F.when((o == 0) & (i == 0), "isolated").when(o == 0, "leaf").when(i == 0, "root").when((o >= HUB_DEGREE) | (i >= HUB_DEGREE), "hub").otherwise("cluster")
    return total.withColumn("role", role)


def stats(degree: DataFrame) -> DataFrame:
    """One row: total_files, total_edges, average_out_degree, and files of each role but isolated ones."""
    n = lambda r: F.count_if(F.col("role") == r).alias(f"{r}_files")
    out = degree.agg(F.count("*").alias("total_files"), F.sum("out_degree").alias("total_edges"), n("leaf"), n("root"), n("hub"), n("cluster"))
    return out.withColumn("average_out_degree", F.bround(F.col("total_edges") / F.greatest(F.col("total_files"), F.lit(1)), 2))


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(direction, file): what a file imports and what imports it."""
    out = edges.where(F.col("src") == node).select(F.lit("imports").alias("direction"), F.col("dst").alias("file"))
    return out.unionByName(edges.where(F.col("dst") == node).select(F.lit("imported_by").alias("direction"), F.col("src").alias("file")))


def tree(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, path, node, depth, cycle): all import chains from roots (a column root), in preorder by path.

    A node that its own chain already holds is one row with cycle true and ends the chain.
    """
    edges = edges.select("src", "dst").distinct()
    level = roots.select("root", F.array("root").alias("path"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("cycle"))
    out = level
    for d in range(1, depth + 1):
        step = level.where("NOT cycle").join(edges, F.col("node") == F.col("src"))
        level = step.select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), F.lit(d).alias("depth"), F.array_contains("path", F.col("dst")).alias("cycle"))
        out = out.unionByName(level)
    return out


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(src, dst): every pair with a path of at least one edge. Eager; path lengths double each round."""
    now = checkpointed(edges.select("src", "dst").distinct())
    n = now.count()
    for _ in range(most_rounds):
        step = now.alias("a").join(now.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        now = checkpointed(now.unionByName(step).distinct())
        if (m := now.count()) == n:
            break
        n = m
    return now


def _until_stable(frame: DataFrame, step, most: int | None = None) -> DataFrame:
    """Repeat a step on a checkpointed frame until its rows stay the same (or ``most`` times)."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first())
    now = checkpointed(frame)
    seen, rounds = mark(now), 0
    while seen[0] and rounds != most:
        now = checkpointed(step(now))
        before, seen = seen, mark(now)
        rounds += 1
        if seen == before:
            break
    return now


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing leads to, or that lead nowhere; a few rounds, as this only saves work."""

    def step(now: DataFrame) -> DataFrame:
        into, out = now.select(F.col("dst").alias("src")).distinct(), now.select(F.col("src").alias("dst")).distinct()
        return now.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")

    return _until_stable(edges, step, most=3)


def strong_groups(edges: DataFrame) -> DataFrame:
    """(node, scc) of every node on a cycle of two nodes or more; scc: the smallest node of its group. Eager.

    Nodes that no cycle can hold go first. Each round labels every node with the smallest node that leads to it; what leads back to that node along nodes
    of the same label is its group, and leaves the graph. Tables are of nodes and edges, never of pairs.
    """
    live = _trimmed(edges.where("src != dst").select("src", "dst").distinct())
    if live.select("src").unionByName(live.select(F.col("dst").alias("src"))).distinct().count() <= SMALL_GRAPH:
        reach = closure(live)
        mutual = reach.alias("a").join(reach.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")))
        return mutual.groupBy(F.col("a.src").alias("node")).agg(F.min("a.dst").alias("scc"))
    found = live.select(F.col("src").alias("node"), F.col("dst").alias("scc")).limit(0)
    while not live.isEmpty():
        rest = live
        nodes = rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct()
        spread = lambda now, rest=rest: now.unionByName(rest.join(now, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
        label = _until_stable(nodes.select("node", F.col("node").alias("label")), spread)
        of = lambda end: label.select(F.col("node").alias(end), F.col("label").alias(f"__{end}"))
        alike = checkpointed(rest.join(of("src"), "src").join(of("dst"), "dst").where("__src = __dst").select("src", "dst", F.col("__src").alias("label")))
        back = lambda now, alike=alike: now.unionByName(alike.join(now, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), alike["label"])).distinct()
        group = _until_stable(label.where("node = label"), back)
        several = group.groupBy("label").count().where("count > 1").select("label")
        found = found.unionByName(group.join(several, "label").select("node", F.col("label").alias("scc")))
        gone = lambda end: group.select(F.col("node").alias(end))
        live = _trimmed(rest.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"))
    return found


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node) of every node on a cycle of two nodes or more."""
    return strong_groups(edges).select("node")


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle array<string>): one for each back edge of a depth-first walk, as a report of a repository lists them.

    The walk is inherently sequential: roots and neighbours in order, visited nodes shared. Only nodes of
    cycles take part, group by strongly connected group, so a task holds one group of files that import each other.
    """
    group = strong_groups(edges)
    inside = (
        edges.where("src != dst")
        .select("src", "dst")
        .distinct()
        .join(group.select(F.col("node").alias("src"), "scc"), "src")
        .join(group.select(F.col("node").alias("dst"), F.col("scc").alias("scc2")), "dst")
        .where("scc = scc2")
        .select("scc", "src", "dst")
    )
    importable(edges.sparkSession)
    return inside.groupBy("scc").applyInPandas(_back_edges, "cycle array<string>")


def _back_edges(frame):
    import pandas as pd

    following: dict = {}
    for a, b in sorted(zip(frame["src"], frame["dst"])):
        following.setdefault(a, []).append(b)
    seen: set = set()
    found = []
    for root in sorted(following):
        if root in seen:
            continue
        seen.add(root)
        chain, todo = [root], [iter(following[root])]
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                chain.pop()
            elif step in chain:
                found.append([*chain[chain.index(step) :], step])
            elif step not in seen:
                seen.add(step)
                chain.append(step)
                todo.append(iter(following.get(step, [])))
    return pd.DataFrame({"cycle": found})


def path_tree(files: DataFrame, depth: int = 2) -> DataFrame:
    """(depth, entry, is_dir): folders and files down to a depth, hidden ones left out."""
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))
    row = F.transform(levels, lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("entry"), (i < F.size(parts)).alias("is_dir"), F.exists(F.slice(parts, 1, i), lambda x: x.startswith(".")).alias("hidden")))
    return files.select(F.explode(row).alias("e")).where("NOT e.hidden").select("e.depth", "e.entry", "e.is_dir").distinct()

