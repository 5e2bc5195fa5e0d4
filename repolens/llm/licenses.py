"""License scans: texts against licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised to lower-case words. A passage of a text is compared with a template only
if its number of distinct bigrams lies in the bounds that the threshold allows (2 / (1 + size ratio) must reach
it), and passages are looked for only around bigrams of the template, so nearly all of a text is never compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import schema_with

THRESHOLD = 0.8

# Notices and opening paragraphs of public licences, by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-2-Clause OR BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def whole_texts() -> tuple[tuple[str, str], ...]:
    """(SPDX identifier, text) of the files of templates/, by name."""
    files = [f for f in resources.files(__package__).joinpath("templates").iterdir() if f.name.endswith(".txt")]
    return tuple((f.name[:-4], f.read_text(encoding="utf-8")) for f in sorted(files, key=lambda f: f.name))


TEMPLATES = NOTICES + whole_texts()


@dataclass
class Template:
    name: str
    bigrams: np.ndarray


def compiled(templates) -> list[Template]:
    out = []
    for name, text in templates:
        piece = next(B.slices(pa.array([text])))
        out.append(Template(name, np.unique(B.grams(B.words(piece, B.WORD_BY_ALNUM).hash, 2))))
    return [t for t in out if len(t.bigrams)]


def _same_windows(gram: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first of the windows [low, high) of gram with each content, by a polynomial hash of 64 bits."""
    base, size = 0x9E3779B97F4A7C15, int(high.max() - low[0])
    powers = np.multiply.accumulate(np.concatenate([[1], np.full(size, base)]).astype(np.uint64))
    back = np.multiply.accumulate(np.concatenate([[1], np.full(size, pow(base, -1, 1 << 64))]).astype(np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gram[low[0] : low[0] + size] * powers[:size])])
    key = (total[high - low[0]] - total[low - low[0]]) * back[low - low[0]]
    return np.sort(np.unique(key + (high - low).astype(np.uint64), return_index=True)[1])


def best_passage(gram: np.ndarray, at: np.ndarray, template: Template, threshold: float) -> tuple[float, int, int]:
    """Highest Dice of a passage of the text with the template, and the passage's bigrams; 0 if none reaches the threshold.

    gram: the text's bigrams; at: places of those that some template has, ascending. A best passage begins and
    ends with bigrams of the template. Of equal ones the first counts; where a text repeats itself, equal
    surroundings are looked at once.
    """
    at = at[np.isin(gram[at], template.bigrams)]
    m = len(template.bigrams)
    least, most = threshold / (2 - threshold) * m, (2 - threshold) / threshold * m
    code = np.unique(gram[at], return_inverse=True)[1]
    if not len(at) or code.max() + 1 < least:
        return 0.0, 0, 0
    order = np.argsort(code, kind="stable")
    before = np.full(len(at), -1)
    again = code[order[1:]] == code[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    to = np.searchsorted(at, at + int(most) + m)
    best = (0.0, 0, 0)
    for i in _same_windows(gram, at, at[to - 1] + 1).tolist():
        if to[i] - i < least or best[0] == 1.0:
            continue
        seen = np.cumsum(before[i : to[i]] < i)
        size = seen + (at[i : to[i]] - at[i]) - np.arange(to[i] - i)
        dice = np.where((seen >= least) & (size <= most), 2 * seen / (size + m), 0.0)
        j = int(np.argmax(dice))
        if dice[j] > best[0]:
            best = (float(dice[j]), int(at[i]), int(at[i + j]) + 1)
    return best if best[0] >= threshold else (0.0, 0, 0)


def settled(found: list[tuple[float, int, int, int, str]]) -> list[tuple[str, float]]:
    """(name, dice) of the licences found, best first, from (dice, low, high, shared bigrams, name).

    A passage counts for the template with which it shares most, and a licence once.
    """
    taken: list[tuple[int, int]] = []
    out: dict[str, float] = {}
    for dice, low, high, _, name in sorted(found, key=lambda x: (-x[3], -x[0], x[4])):
        if dice and not any(low < b and a < high for a, b in taken):
            taken.append((low, high))
            out.setdefault(name, dice)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def _scan(templates: list[Template], threshold: float):
    known = np.unique(np.concatenate([t.bigrams for t in templates])) if templates else np.zeros(0, np.uint64)
    has = np.array([np.isin(known, t.bigrams) for t in templates]).T
    least = np.array([threshold / (2 - threshold) * len(t.bigrams) for t in templates])

    def candidates(owner: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """(text, template) of all pairs in which the text has enough distinct bigrams of the template."""
        pairs = np.unique(owner * len(known) + which)
        text, own = pairs // len(known), has[pairs % len(known)]
        counts = np.array([np.bincount(text[own[:, t]], minlength=n) for t in range(len(templates))]).T
        return np.argwhere((counts >= least) & (counts > 0))

    def run(batches):
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "__text"]
            for piece in B.slices(batch.column("__text")):
                w = B.words(piece, B.WORD_BY_ALNUM)
                gram = B.grams(w.hash, 2)
                found: list[list] = [[] for _ in range(piece.n)]
                if len(gram) and len(known):
                    near = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    at = np.flatnonzero(known[near] == gram)
                    owner = np.searchsorted(w.first, at, "right") - 1
                    inside = at + 1 < w.first[owner + 1]
                    at, owner = at[inside], owner[inside]
                    for d, t in candidates(owner, near[at], piece.n).tolist():
                        mine = at[np.searchsorted(owner, d) : np.searchsorted(owner, d, "right")]
                        dice, low, high = best_passage(gram, mine, templates[t], threshold)
                        if dice:
                            shared = int(np.isin(templates[t].bigrams, gram[low:high]).sum())
                            found[d].append((dice, low, high, shared, templates[t].name))
                best = [settled(x) for x in found]
                names, scores = [[n for n, _ in x] for x in best], [[s for _, s in x] for x in best]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(piece.first, piece.n) for c in rest), pa.array(names, pa.list_(pa.string())), pa.array(scores, pa.list_(pa.float64()))], [*rest, "licenses", "dice"]
                )

    return run


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, licenses and dice of each row of docs: the licences found, best first.

    Ties are in the order of the names. A null or empty text, or one of a single word, has none. Words are
    ASCII letters and digits, A-Z lower-cased, and non-ASCII characters.
    """
    B.bounded_batches(docs.sparkSession)
    schema = schema_with(docs, keep, "licenses array<string>, dice array<double>")
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("__text")).mapInArrow(_scan(compiled(templates), threshold), schema)


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, license_id, dice, n_licenses, licenses) of each document; license_id is null where none is found."""
    return scan(docs).select("doc_id", F.get("licenses", F.lit(0)).alias("license_id"), F.coalesce(F.get("dice", F.lit(0)), F.lit(0.0)).alias("dice"), F.size("licenses").cast("bigint").alias("n_licenses"), F.concat_ws(",", "licenses").alias("licenses"))
