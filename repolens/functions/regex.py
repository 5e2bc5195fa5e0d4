"""Patterns written for one dialect (Unicode classes, ``\\n`` as the only line end) as Java patterns."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"


def java(pattern: str) -> str:
    """The Java pattern with the same matches.

    ``\\w``, ``\\W``, ``\\b`` and ``\\d`` become Unicode-aware, ``.``, ``^`` and ``$`` know ``\\n`` only, an
    inline ``i`` flag folds case beyond ASCII, and named groups lose the ``P``.
    """
    flags = "d"
    if m := re.match(r"\(\?([a-z]+)\)", pattern):
        pattern = pattern[m.end() :]
        flags += m[1] + ("u" if "i" in m[1] else "")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n == "w":
                out.append(_WORD if in_class else f"[{_WORD}]")
            elif n == "W" and not in_class:
                out.append(f"[^{_WORD}]")
            elif n == "d":
                out.append(r"\p{Nd}")
            elif n == "b" and not in_class:
                out.append(f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))")
            else:
                out.append("\\" + n)
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if c == "[" or (c == "&" and in_class and pattern[i + 1 : i + 2] == "&"):
            out.append("\\")
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return f"(?{flags})" + "".join(out)


def literal(text: str) -> str:
    """A Java pattern for the text itself."""
    return "".join(c if c.isalnum() or ord(c) > 127 or c in "_ " else "\\" + c if c not in "\n\t" else {"\n": "\\n", "\t": "\\t"}[c] for c in text)


def whole_word(symbol: str) -> str:
    """The symbol with no word character right before or after it."""
    return java(r"\b") + literal(symbol) + java(r"\b")[4:] if re.match(r"\w", symbol) else literal(symbol)


def replacement(text: str) -> str:
    """A replacement string that stands for the text itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def needles(pattern: str, fold: bool = True) -> frozenset[str] | None:
    """ASCII texts of which every match of a pattern holds one, or None: in lower case, or with fold=False as they stand.

    Of all such sets that the pattern's parts give, the one whose shortest text is longest. A pattern that does
    not regard case has no texts as they stand.
    """
    parsed = _parser.parse(pattern)
    if not fold and parsed.state.flags & re.IGNORECASE:
        return None
    letter = lambda c: chr(c).lower() if fold else chr(c)

    def of(items) -> frozenset[str] | None:
        found: list[frozenset[str]] = []
        run = ""
        for op, value in [*items, (None, None)]:
            if op is K.IN and all(o is K.LITERAL for o, _ in value) and len({letter(c) for _, c in value}) == 1:
                op, value = value[0]
            if op is K.LITERAL and value < 128:
                run += letter(value)
                continue
            if run:
                found.append(frozenset([run]))
            run, part = "", None
            if op is K.SUBPATTERN:
                part = of(value[-1])
            elif op is K.BRANCH:
                parts = [of(x) for x in value[1]]
                part = frozenset().union(*parts) if all(parts) else None
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0]:
                part = of(value[2])
            if part:
                found.append(part)
        return max(found, key=lambda x: min(map(len, x)), default=None)

    return of(parsed)


def folded(text: Column) -> Column:
    """Lower case, in which the letters that match ASCII ones without regard to case are these."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, "\u017f\u0131\u0307", "si"))


def may_match(low: Column, pattern: str) -> Column:
    """False only where a pattern cannot match the text that low is folded() of."""
    out = F.lit(True)
    for i, text in enumerate(sorted(needles(pattern) or ())):
        out = low.contains(text) if i == 0 else out | low.contains(text)
    return out
