"""Operators on files, repositories and edits."""

from __future__ import annotations

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from repolens.functions.regex import needles
from repolens.operators import deadcode, graph, history, metrics, pysyntax, render, rewrite, search, secrets, symbols, trace
from repolens.plans import fixtures as X
from repolens.sources import files as S
from repolens.sources import history as H
from repolens.streaming import streams


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    texts = {
        "main.py": "import utils\n# TODO: first\ndef run():\n    return utils.go()\n",
        "utils.py": "def go():\n    return 1\r\n",
        "sub/mod.ts": 'import { a } from "./other";\n',
        "sub/other.ts": "export const a = 1;\n",
        "data.json": '{"a": 1}\n',
        "pic.png": "not a picture",
        "node_modules/x.js": "hidden",
        ".git/config": "[core]",
        ".github/y.py": "z = 1",
        "build/gen.py": "g = 1",
    }
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(root)


def paths(frame):
    return sorted(r["path"] for r in frame.select("path").collect())


def test_scans(spark, tree):
    assert paths(S.scan_sources(spark, tree)) == ["main.py", "sub/mod.ts", "sub/other.ts", "utils.py"]
    assert paths(S.scan_sources(spark, tree, "py")) == ["main.py", "utils.py"]
    assert paths(S.scan_sources(spark, tree, most_files=1)) == ["main.py"]
    assert paths(S.scan_audit(spark, tree)) == ["data.json", "main.py", "sub/mod.ts", "sub/other.ts", "utils.py"]
    assert "pic.png" in paths(S.scan_search(spark, tree)) and not [p for p in paths(S.scan_search(spark, tree)) if ".git" in p or "node_modules" in p]
    counts = {r["path"]: (r["newlines"], r["lines"]) for r in S.scan_all(spark, tree).collect()}
    assert counts["main.py"] == (4, 4) and counts["pic.png"] == (0, 1)
    assert paths(S.scan(spark, tree, "dead")) == paths(S.scan(spark, tree, "health")) == paths(S.scan(spark, tree, "impact")) == ["main.py", "sub/mod.ts", "sub/other.ts", "utils.py"]
    assert paths(S.scan(spark, tree, "impact", "js")) == ["sub/mod.ts", "sub/other.ts"] and paths(S.scan(spark, tree, "impact", "cobol")) == []
    assert S.scan_sources(spark, tree).where("path = 'utils.py'").first()["content"] == "def go():\n    return 1\n"


def test_snapshot_of_a_folder(spark, tree):
    report = render.snapshot_text(metrics.snapshot(S.scan_all(spark, tree), H.workspace(spark, tree)), render.tree_text(S.scan_all(spark, tree), "tree"), "tree", "today", "1").first()["report"]
    assert "- **Total files:** 6" in report and "  - `.ts`: 2" in report and "tree/\n  data.json\n  main.py\n  pic.png\n  sub/\n    mod.ts\n    other.ts\n  utils.py" in report


def test_formatters_run_once_each(spark, tmp_path):
    runs = H.formatter_output(spark, str(tmp_path), check=True, ruff=True, prettier=True)
    assert [(r["tool"], r["check"]) for r in runs.collect()] == [("ruff", True), ("prettier", True)]


def test_search_over_files(spark, tree):
    files = S.scan_search(spark, tree)
    hits = search.search(files, r"def \w+", include="*.py", context=1).orderBy("path").collect()
    assert [(r["path"], r["line_no"], r["context_before"], r["context_after"]) for r in hits] == [("main.py", 3, ["# TODO: first"], ["    return utils.go()"]), ("utils.py", 1, [], ["    return 1"])]
    assert search.search(files, "(").count() == 0 and search.matching_lines(files, "x" * 1001).count() == 0


def test_include_truth_table(spark):
    names = ["a.py", "x.pyc", "test_a.py", "a.txt"]
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    hits = lambda p: paths(frame.where(S.included("path", p)))
    assert hits("*.py") == ["a.py", "test_a.py", "x.pyc"] and hits(".py") == ["a.py", "test_a.py"] and hits("test*py") == ["test_a.py"]


def test_import_graph_of_files(spark, tree):
    edges = graph.import_graph(S.scan_sources(spark, tree))
    assert sorted(tuple(r) for r in edges.collect()) == [("main.py", "utils.py"), ("sub/mod.ts", "sub/other.ts")]


def test_git_readers(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    for i, message in enumerate(["feat: one", "fix(core): two", "plain"]):
        (tmp_path / "a.txt").write_text(str(i))
        (tmp_path / f"b{i}.txt").write_text("x")
        git("add", "-A")
        git("commit", "-qm", message)
    root = str(tmp_path)
    commits = history.parse_commits(H.commit_lines(spark, root)).orderBy("seq").collect()
    assert [r["category"] for r in commits] == ["Other", "Bug Fixes", "Features"]
    assert H.commit_lines(spark, root, limit=1).count() == 1
    top = history.churn(H.commit_files(spark, root), least=1).collect()
    assert tuple(top[0]) == ("a.txt", 3) and [r["file"] for r in top[1:]] == ["b2.txt", "b1.txt", "b0.txt"]
    (tmp_path / "a.txt").write_text("changed")
    assert "+changed" in H.diff(root, "a.txt") and H.diff(root, "none.txt") is None
    assert H.workspace(spark, root).first()["subject"] == "plain" and H.top_level(root) == root


def test_rule_file_and_commands(spark, tmp_path):
    (tmp_path / "allow").write_text("# note\n\nexample\\d+\n")
    rules = [r["pattern"] for r in H.rule_file(spark, str(tmp_path / "allow")).collect()]
    files = spark.createDataFrame([("a", "token = 0123456789abcdefghij\ntoken = 0123456789abcdefghij EXAMPLE7")], "path string, content string")
    assert rules == ["example\\d+"] and [r["line_no"] for r in secrets.findings(files, rules).where("severity = 'high'").collect()] == [1]
    assert H.package_command('{"scripts": {"tsc": "tsc --noEmit"}}') == ["npx", "tsc", "--noEmit"] and H.package_command("x") is None
    runs = H.tool_output(spark, str(tmp_path), [("ok", ["true"]), ("bad", ["false"]), ("missing", ["no-such-tool"])])
    assert metrics.gate(runs).first()["ok"] is False and "| ok | ok |" in metrics.markdown(runs)


def test_diamond_tree_has_no_cycle(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], "src string, dst string")
    rows = graph.tree(edges, spark.createDataFrame([("A",)], "root string")).orderBy("path").collect()
    assert [(r["depth"], r["node"], r["cycle"]) for r in rows] == [(0, "A", False), (1, "B", False), (2, "D", False), (1, "C", False), (2, "D", False)]
    assert metrics.call_tree([(r["depth"], r["node"], r["cycle"]) for r in rows]).split("\n")[1] == "├── B"


def test_cycle_nodes_do_not_depend_on_direction(spark):
    r = random.Random(1)
    edges = spark.createDataFrame([(str(r.randint(0, 30)), str(r.randint(0, 30))) for _ in range(45)], "src string, dst string")
    nodes = lambda e: sorted(x["node"] for x in graph.cycle_nodes(e).collect())
    assert nodes(edges) == nodes(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def test_facts_and_scopes(spark):
    facts = pysyntax.facts(X.code_files(spark)).cache()
    scopes = pysyntax.scopes(facts)
    lines = spark.createDataFrame([("mod.py", 9), ("mod.py", 14), ("mod.py", 3)], "path string, line_no int")
    assert {r["line_no"]: r["scope"] for r in trace.enclosing(lines, scopes).collect()} == {9: "inner", 14: "run", 3: None}
    outside = trace.outside_nested(pysyntax.calls(facts).where("path = 'mod.py'"), scopes, "top")
    assert sorted(r["callee"] for r in outside.collect()) == ["inner", "middle"]
    assert pysyntax.facts_of("def broken(:") == [] and pysyntax.facts_of(None) == []
    pysyntax.register(spark)
    X.code_files(spark, ("mod.py",)).createOrReplaceTempView("code")
    assert spark.sql("SELECT count(*) FROM code, LATERAL py_facts(content) f WHERE f.fact = 'scope'").first()[0] == 6


def test_dead_code_by_file_and_project(spark):
    facts = pysyntax.facts(X.code_files(spark, ("mod.py", "test_mod.py", "defs.py"))).cache()
    by_file = {(r["path"], r["name"]) for r in deadcode.unused_python(facts).collect()}
    project = {r["name"] for r in deadcode.unused_python(facts, project=True).collect()}
    assert ("mod.py", "Runner") in by_file and "Runner" in project and "test_it" not in project


def test_blanking_keeps_lines(spark):
    text = 'a = "x // y"; // c "d\n/* e\nf */ g = `h\ni`;'
    got = spark.createDataFrame([(text,)], "t string").select(symbols.blanked(F.col("t")).alias("t")).first()["t"]
    assert got.count("\n") == 3 and len(got) == len(text) and [w for w in got.replace(";", " ").split()] == ["a", "=", "g", "="]


# --- edits


def apply_plainly(lines: list[str], edits: list[tuple]) -> str:
    before, gone, top, end = {}, set(), [], []
    for kind, cursor, at, text in edits:
        if kind == "delete":
            gone.add(at)
        elif cursor == "bof":
            top.append(text)
        elif cursor == "eof" or (cursor == "after" and at >= len(lines)):
            end.append(text)
        else:
            before.setdefault(at + (cursor == "after"), []).append(text)
    out = []
    for i, line in enumerate(lines, 1):
        out += before.get(i, []) + ([] if i in gone else [line])
    return "\n".join(top + out + end)


def test_random_edits(spark):
    r = random.Random(2)
    files, edits, want = [], [], {}
    for f in range(25):
        lines = [f"line {i}" for i in range(r.randint(2, 8))]
        own = []
        for i in range(r.randint(1, 6)):
            kind = r.choice(["insert", "insert", "delete"])
            cursor = "at" if kind == "delete" else r.choice(["before", "after", "bof", "eof"])
            at = None if cursor in ("bof", "eof") else r.randint(1, len(lines))
            own.append((kind, cursor, at, None if kind == "delete" else f"new {i}"))
        files.append((f"f{f}", "\n".join(lines)))
        edits += [(f"f{f}", *e, i) for i, e in enumerate(own)]
        want[f"f{f}"] = apply_plainly(lines, own)
    out = rewrite.apply_edits(spark.createDataFrame(files, "path string, content string"), spark.createDataFrame(edits, "path string, kind string, cursor string, anchor_line int, text string, idx int"))
    assert {x["path"]: x["content"] for x in out.collect()} == want


def test_edit_texts(spark):
    rows = rewrite.parse_edits("*** Begin Patch\n+ 3ab\n~x\n~y\n- 1aa..3cc\n= 5dd..5dd\n< BOF\n~top\n*** End Patch\n")
    assert [(k, c, a, h, t) for _, k, c, a, h, t, _, _ in rows] == [
        ("insert", "after", 3, "ab", "x"), ("insert", "after", 3, "ab", "y"), ("delete", "at", 1, "aa", None), ("delete", "at", 2, "**", None), ("delete", "at", 3, "cc", None),
        ("insert", "before", 5, "dd", ""), ("delete", "at", 5, "dd", None), ("insert", "bof", None, None, "top"),
    ]
    for bad in ("+ 3ab", "? x", "- 3ab", "- 4ab..3ab", "- 3ab..3cd", "< 3abc\n~x"):
        with pytest.raises(rewrite.EditError):
            rewrite.parse_edits(bad)
    files = spark.createDataFrame([("a", "one\ntwo")], "path string, content string")
    with pytest.raises(rewrite.EditError):
        rewrite.apply_sections(files, "a", "- 1zz..1zz")


def test_rename_round_trip_and_diff(spark):
    files = spark.createDataFrame([("a", "cat concat cat_ cat.\ncat"), ("b", "none")], "path string, content string")
    once = rewrite.renamed(files, "cat", "d$g\\1")
    assert once.where("path = 'a'").first()["content"] == "d$g\\1 concat cat_ d$g\\1.\nd$g\\1"
    there = rewrite.renamed(files, "cat", "dog").select("path", "content")
    back = rewrite.renamed(there, "dog", "cat").select("path", "content")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect()))
    diff = rewrite.unified_diff(files, there).collect()
    assert len(diff) == 1 and "+dog" in diff[0]["diff"]


def test_replace_keeps_the_rest(spark):
    files = spark.createDataFrame([("a", "x\nfoo\nfoo\n")], "path string, content string")
    got = rewrite.replaced_first(files, "foo\n", "bar").first()
    assert (got["status"], got["content"]) == ("replaced", "x\nbar\nfoo\n")
    assert rewrite.edited_or_salvaged(files, "foo\r\nfoo", "z").first()["status"] == "salvaged"
    assert rewrite.edited_or_salvaged(files, "absent", "z").first()["status"] == "failed"


def test_write_back(spark, tmp_path):
    rewrite.write_back(spark.createDataFrame([("s/a.txt", "x\n")], "path string, content string"), str(tmp_path))
    assert (tmp_path / "s/a.txt").read_text() == "x\n"


# --- streaming


def test_file_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.py").write_text("# TODO: a\n# FIXME(x):\nnext\n")
    (folder / "b.py").write_text("pass" + "word = open\n")
    stream = streams.marker_stream(streams.file_stream(spark, str(folder)))
    got = streams.drained(stream, "marker_rows", str(tmp_path / "c1"))
    assert sorted((r["tag"], r["message"]) for r in got.collect()) == [("FIXME", "next"), ("TODO", "a")]
    found = streams.drained(streams.finding_stream(streams.file_stream(spark, str(folder))), "finding_rows", str(tmp_path / "c2"))
    assert [r["rule"] for r in found.collect()] == ["password-field"]


def test_windowed_counts(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 09:00:00", "a")]
    spark.createDataFrame(rows, "ts string, event_type string").selectExpr("cast(ts AS timestamp) AS ts", "event_type").write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(folder)
    got = streams.drained(streams.windowed_counts(stream), "window_rows", str(tmp_path / "c3"))
    assert sorted((r["event_type"], r["n"]) for r in got.collect()) == [("a", 2), ("b", 1)]


def test_syntax_facts_of_deep_and_long_sources():
    """Sums deeper than Python may recurse, and many functions, cost no error."""
    rows = pysyntax.facts_of("x = " + " + ".join(["a"] * 700))
    assert sum(r[0] == "ref" and r[2] == "a" for r in rows) == 700
    assert isinstance(pysyntax.facts_of("x = " + " + ".join(["a"] * 100_000)), list)
    rows = pysyntax.facts_of("\n".join(f"def f{i}():\n    g()\n" for i in range(10_000)))
    assert sum(r[0] == "call" for r in rows) == 10_000 and {r[5] for r in rows if r[0] == "call"} == {f"f{i}" for i in range(10_000)}
    assert [r[7] for r in pysyntax.facts_of("é = 'ß' + b") if r[2] == "b"] == [10]


def test_enclosing_keeps_equal_occurrences(spark):
    occurrences = spark.createDataFrame([("a", 2), ("a", 2), ("a", 9)], "path string, line_no int")
    scopes = spark.createDataFrame([("a", "f", "function", 1, 5), ("a", "g", "function", 2, 3)], "path string, name string, kind string, start int, end int")
    assert sorted((r["line_no"], r["scope"]) for r in trace.enclosing(occurrences, scopes).collect()) == [(2, "g"), (2, "g"), (9, None)]


def test_needles_are_in_every_match():
    """A pattern's texts: each audit rule's examples hold one, and patterns without a certain text have none."""
    assert needles("[Ll]icen[sc]e") == {"licen"} and needles("[Ll]icen[sc]e", fold=False) == {"icen"}
    assert needles("(?i)ab", fold=False) is None and needles("a*") is None and needles("(foo|ba)x?") == {"foo", "ba"} and needles(r"(?:ab)?cd{2}") == {"c"}


def test_strong_groups_of_small_and_large_graphs(spark, monkeypatch):
    r = random.Random(3)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(36)} | {(100, 101), (101, 100), (101, 102), (102, 103), (103, 102), (7, 7)}
    reach = {x: {b for a, b in edges if a == x and b != x} for x, _ in edges}
    for _ in range(40):
        reach = {x: to.union(*(reach.get(y, set()) for y in to)) for x, to in reach.items()}
    want = {x: min(y for y in to if x in reach.get(y, set())) for x, to in reach.items() if x in to}
    frame = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    for small in (1000, 0):
        monkeypatch.setattr(graph, "SMALL_GRAPH", small)
        assert {r["node"]: r["scc"] for r in graph.strong_groups(frame).collect()} == want
