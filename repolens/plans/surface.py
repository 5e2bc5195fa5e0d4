"""The SQL surface: a file set as views and functions, so that every analysis can be written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import with_lines
from ..operators import graph, markers, pysyntax, secrets, trace
from ..operators.search import tokens


def register(files: DataFrame, prefix: str = "") -> list[str]:
    """Views files, lines, tokens, symbols, edges, markers and findings, and the table function py_facts.

    The views are lazy; a query reads and computes only what it uses. Returns their names.
    """
    pysyntax.register(files.sparkSession)
    views = {
        "files": files,
        "lines": with_lines(files.select("path", "lang", "content")),
        "tokens": tokens(files, ("path", "lang")),
        "symbols": trace.tags_in(files),
        "edges": graph.import_graph(files),
        "markers": markers.markers(files),
        "findings": secrets.findings(files),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
