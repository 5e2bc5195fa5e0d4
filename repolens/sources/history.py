"""Version-control logs, rule files and command lists, read on the driver into DataFrames.

Each reader runs one command or reads one small file; what the engine does with it is in ``operators``.
"""

from __future__ import annotations

import json
import subprocess
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEOUT = 15


def run(args: list[str], cwd: str, timeout: int = TIMEOUT) -> str:
    """Output of a command; empty if it fails, is missing or takes too long."""
    try:
        done = subprocess.run(args, cwd=cwd, capture_output=True, text=True, timeout=timeout, errors="replace")
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout if done.returncode == 0 else ""


def _lines(spark: SparkSession, name: str, text: str) -> DataFrame:
    rows = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
    return spark.createDataFrame(rows, f"seq bigint, {name} string")


def commit_lines(spark: SparkSession, root: str, since: str | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
    """(seq, line) of the one-line log, newest first; the limit applies with no other restriction."""
    args = ["git", "log", "--oneline", "--no-decorate"]
    args += [f"--since={since}"] if since else []
    args += ["--", path] if path else []
    args[2:2] = [] if since or path else [f"-n{limit}"]
    return _lines(spark, "line", run(args, root))


def commit_files(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(seq, file) of every file of every commit, newest commit first."""
    args = ["git", "log", "--pretty=format:", "--name-only", "--diff-filter=AMCR"]
    return _lines(spark, "file", run(args + ([f"--since={since}"] if since else []), root))


def workspace(spark: SparkSession, root: str) -> DataFrame:
    """One row: branch, commit, subject, number of changed files, the first twenty of them and the last ten commits."""
    git = lambda *a: run(["git", *a], root).strip()
    changed = [x for x in run(["git", "status", "--porcelain"], root).split("\n") if x.strip()]
    recent = [x for x in git("log", "--oneline", "-10").split("\n") if x]
    row = (git("rev-parse", "--abbrev-ref", "HEAD") or "(not a git repo)", git("rev-parse", "--short", "HEAD"), git("log", "-1", "--pretty=%s"), len(changed), changed[:20], recent)
    return spark.createDataFrame([row], "branch string, commit string, subject string, n_changed int, changed array<string>, recent array<string>")


def diff(root: str, path: str, staged: bool = False) -> str | None:
    """The diff of a tracked file, or None if it is not tracked."""
    if not run(["git", "ls-files", "--error-unmatch", path], root):
        return None
    return run(["git", "diff", *(["--cached"] if staged else []), "--", path], root)


def top_level(path: str) -> str:
    """The repository that holds a folder, or the folder itself."""
    return run(["git", "rev-parse", "--show-toplevel"], path).strip() or path


def rule_file(spark: SparkSession, path: str) -> DataFrame:
    """(ord, pattern): one case-insensitive pattern a line; blank lines and those that begin with # go."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("pattern"))
    return lines.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))


def package_command(package_json: str) -> list[str] | None:
    """The first of a package file's lint, typecheck and tsc scripts, as a command."""
    try:
        scripts = json.loads(package_json).get("scripts", {})
    except (ValueError, AttributeError):
        return None
    return next((["npx", *scripts[k].split()] for k in ("lint", "typecheck", "tsc") if scripts.get(k)), None)


def detect_command(root: str) -> list[str] | None:
    path = Path(root) / "package.json"
    return package_command(path.read_text(encoding="utf-8")) if path.exists() else None


def formatter_output(spark: SparkSession, root: str, check: bool = False, ruff: bool = True, prettier: bool = False) -> DataFrame:
    """tool_output() of the formatters asked for, with a column check: whether they only looked."""
    ruff_args = [sys.executable, "-m", "ruff", "format", *(["--check"] if check else []), "."]
    prettier_args = ["npx", "prettier", "--check" if check else "--write", "--ignore-path", ".gitignore", "."]
    runs = [tool_output(spark, root, [(n, a)], seconds) for n, a, seconds, on in (("ruff", ruff_args, 60, ruff), ("prettier", prettier_args, 120, prettier)) if on]
    return reduce(DataFrame.unionByName, runs).withColumn("check", F.lit(check))


def tool_output(spark: SparkSession, root: str, tools: list[tuple[str, list[str]]], timeout: int = 300) -> DataFrame:
    """(tool, status, exit_code, elapsed, output): each command run once on the driver."""
    import time

    rows = []
    for name, args in tools:
        began = time.time()
        try:
            done = subprocess.run(args, cwd=root, capture_output=True, text=True, timeout=timeout, errors="replace")
            code, out = done.returncode, done.stdout + done.stderr
        except (OSError, subprocess.TimeoutExpired) as e:
            code, out = -1, str(e)
        rows.append((name, "ok" if code == 0 else "fail", code, time.time() - began, out))
    return spark.createDataFrame(rows, "tool string, status string, exit_code int, elapsed double, output string")
