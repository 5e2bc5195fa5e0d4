"""Patterns and text functions against Python's own."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolens.functions import text as T
from repolens.functions.regex import java, literal, replacement, whole_word


@pytest.mark.parametrize(
    ("pattern", "line"),
    [
        (r"\bword\b", "a word, b"),
        (r"\bword\b", "swords"),
        (r"\bé\w+", "x été"),
        (r"(?i)straße", "STRAßE"),
        (r"[\w.]+@x", "a.b-c.d@x"),
        (r"(?P<n>\d+)$", "line 12"),
        (r"[^]a]b", "]b cb"),
        (r"^x.y$", "x y"),
        (r"a[&&b]c", "a&c"),
        (r"[a[b]", "x[y"),
    ],
)
def test_java_finds_what_python_finds(spark, pattern, line):
    frame = spark.createDataFrame([(line,)], "line string")
    got = frame.select(F.regexp_extract("line", java(pattern), 0).alias("m"), F.col("line").rlike(java(pattern)).alias("hit")).first()
    want = re.search(pattern, line)
    assert got["hit"] == bool(want) and got["m"] == (want.group() if want else "")


def test_literals_and_replacements(spark):
    odd = r"a.b*c$1\d+(x)[y]{z}|^" + "\t"
    frame = spark.createDataFrame([(f"<{odd}>",)], "line string")
    got = frame.select(F.regexp_replace("line", literal(odd), replacement(odd + odd)).alias("x")).first()["x"]
    assert got == f"<{odd}{odd}>"
    word = frame.sparkSession.createDataFrame([("foo foobar foo_ foo. éfoo",)], "line string")
    assert word.select(F.regexp_replace("line", whole_word("foo"), "X").alias("x")).first()["x"] == "X foobar foo_ X. éfoo"


def test_line_hash_and_checksum_equal_python(spark):
    lines = ["", "x", "  two words  ", "tab\tand é", "cr\r"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(T.line_hash("line").alias("h"), T.checksum("line").alias("c")).collect()
    for line, r in zip(lines, got):
        n = int.from_bytes(hashlib.sha256(line.replace("\r", "").encode()).digest()[:8], "little") % 676
        assert r["h"] == chr(97 + n // 26) + chr(97 + n % 26)
        assert r["c"] == hashlib.sha256(line.encode()).hexdigest()[:12]


def test_decoded_equals_python(spark):
    raws = [b"\xef\xbb\xbfabc\r\nd\re", b"bad \xff\xc3 end", "é".encode(), b""]
    frame = spark.createDataFrame([(bytearray(x),) for x in raws], "raw binary")
    for raw, r in zip(raws, frame.select(T.decoded("raw").alias("t")).collect()):
        assert r["t"] == raw.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")


def test_extensions(spark):
    names = ["a.py", "b/c.TS", ".hidden", "x.tar.gz", "none", "d.e/f", ".a.b"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "p string").select(T.extension("p")).collect()]
    assert got == [".py", ".ts", "", ".gz", "", "", ".b"]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab\n:x ", max_size=30))
def test_matches_count_lines(spark, text):
    frame = spark.createDataFrame([("f", text)], "path string, content string")
    got = [(r["line_no"], r["g1"]) for r in T.matches(frame, java(r"(a+)"), 1).orderBy("ord").collect()]
    assert got == [(text[: m.start()].count("\n") + 1, m.group(1)) for m in re.finditer("(a+)", text)]


def test_matches_of_a_long_file(spark):
    text = "\n".join(f"x = {i}\nhit {i}" if i % 3 else "hit" for i in range(5000))
    frame = spark.createDataFrame([("f", text)], "path string, content string")
    got = [r["line_no"] for r in T.matches(frame, java("(hit)"), 1).orderBy("ord").collect()]
    assert got == [text[: m.start()].count("\n") + 1 for m in re.finditer("hit", text)]


def test_shown_lines(spark):
    texts = ["", "\n", "a", "a\n", "a\nb", "\n\n"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(T.shown_lines("t")).collect()]
    assert got == [len([*x.splitlines()]) for x in texts]
