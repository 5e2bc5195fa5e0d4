"""Small code corpora as inline rows, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..sources.files import language

PY_DEFS = "\nclass Shape:\n    def area(self):\n        return 0\n\ndef helper(x):\n    return x\n\nasync def fetch():\n    return helper(1)\n\nLIMIT = 10\n\nclass Circle(Shape):\n    pass\n"
CALLS = "def bottom():\n    return 1\n\ndef middle():\n    return bottom()\n\ndef top():\n    def inner():\n        return hidden()\n    return middle() + inner()\n\nclass Runner:\n    def run(self):\n        return top()\n"
TEST_CALLS = "from mod import top\n\ndef test_it():\n    assert top() == 1\n"
CPP = '#include "engine.h"\n#define MAX_ITEMS 64\nclass Engine {\n};\nint add(int a, int b) {\n  return helper(a) + b;\n}\nvoid Engine::start() {\n  if (ready()) { add(1, 2); }\n}\n'
TS = 'import { x } from "./util";\nexport const run = (a) => helper(a);\nexport class Panel {\n}\nfunction helper(v) {\n  return v; // function ghost()\n}\ninterface Props {\n}\nconst text = "class Fake";\n'
PROJECT = {
    "main.py": "import utils\nimport models\n",
    "utils.py": "import models\n",
    "models.py": "import os\n",
    "standalone.py": "import sys, json\n",
    "cli.py": "from main import run\n",
}
CODE = {"defs.py": PY_DEFS, "mod.py": CALLS, "test_mod.py": TEST_CALLS, "engine.cpp": CPP, "panel.ts": TS, **PROJECT}
LINT = (
    "src/a.py:10:5: E501 line too long",
    "src/b.js:3:7: error Unexpected token",
    "src/c.ts(4,9): error TS2304: Cannot find name",
    "src/d.py:12: error: Incompatible types",
    "src/e.py:7:1: C0103: Invalid name",
    "src/f.py:9: something odd",
    "no issue here",
)
COMMITS = (
    "a1b2c3d feat: add search",
    "b2c3d4e fix(core): handle nulls",
    "c3d4e5f feat(auth,api)!: drop old tokens",
    "d4e5f6a random: words",
    "e5f6a7b plain message",
    "",
    "f6a7b8c (tag) docs: explain: twice",
    "not a commit",
)
MARKED = "x = 1  # TODO: x\nplain\n# FIXME(bob): y  \n# NOTE:\nnext line\nMYTODO: not one\n// hack : z\n"


def code_files(spark: SparkSession, names: tuple[str, ...] | None = None) -> DataFrame:
    rows = [(k, v) for k, v in CODE.items() if names is None or k in names]
    files = spark.createDataFrame(rows, "path string, content string")
    return files.select("path", extension("path").alias("ext"), language(extension("path")).alias("lang"), F.octet_length("content").alias("size"), "content")


def lines_of(spark: SparkSession, lines: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "seq bigint, line string")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """SELECT of literal rows: the expected result, derived by hand."""

    def show(v) -> str:
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def code_values(names: tuple[str, ...]) -> str:
    return values([(k, CODE[k]) for k in names], "path, content")
