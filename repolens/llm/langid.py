"""Language identification of whole texts, with spans of mixed-language text.

Training counts hashed character n-grams of words per language on a bounded sample of labelled rows, and the
scripts that each language is written in. A word of a text is scored only against languages of its script;
Viterbi with a switching penalty then labels every word, which cuts a text into spans of one language. The
text's label is the language with most letters, its score that language's share of the letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import apart, schema_with

#: Training reads about this many labelled rows, picked by a hash of doc_id, at any size of the table.
TRAIN_ROWS = 20_000
_TRAIN_PARTS = 12
_TABLE = 1 << 16
_SIZES = (2, 3, 4)
_GAP = max(_SIZES)
#: Nats: what a change of language costs, and the most that one word can say against one.
SWITCH = 10.0
CLIP = 6.0
#: A language is written in a script if this share of its words is.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"

# First and last code point of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
_NAMES = [*dict.fromkeys(s[0] for s in SCRIPTS), "other"]
_LOW = np.array([s[1] for s in SCRIPTS])
_HIGH = np.array([s[2] for s in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(s[0]) for s in SCRIPTS])

LETTERS = np.zeros(256, dtype=bool)
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    LETTERS[_a:_b] = True


def _code_points(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Code point that begins at each byte."""
    get = lambda i: data[np.minimum(start + i, len(data) - 1)].astype(np.int64)
    a, b, c, d = get(0), get(1) & 63, get(2) & 63, get(3) & 63
    return np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)


def scripts_of(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Script number of the character at each byte."""
    code = _code_points(data, start)
    at = np.searchsorted(_LOW, code, "right") - 1
    known = (at >= 0) & (code <= _HIGH[np.maximum(at, 0)])
    return np.where(known, _SCRIPT[np.maximum(at, 0)], len(_NAMES) - 1)


@dataclass
class _Distinct:
    """Distinct words of a slice: the word number of each, its cells of the feature table, script and letters."""

    inverse: np.ndarray
    cells: np.ndarray
    first: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def _distinct(piece: B.Slice, w: B.Words) -> _Distinct:
    data = B.LOWER[piece.data]
    _, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    start, length = w.start[index], (w.end - w.start)[index]
    # a blank, the word, and zeros, so that no n-gram reaches into another word
    base = np.cumsum(length + _GAP) - (length + _GAP)
    padded = np.zeros(int((length + _GAP).sum()), np.uint32)
    padded[base] = 0x20
    padded[B.ranges(base + 1, length)] = data[B.ranges(start, length)]
    at = B.ranges(base, length + 1)
    first = np.cumsum(length + 1) - (length + 1)
    cells = []
    for size in _SIZES:
        code = np.full(len(at), size, np.uint64)
        for j in range(size):
            code = code * np.uint64(257) + padded[at + j]
        cells.append((B.mix64(code) & np.uint64(_TABLE - 1)).astype(np.int64))
    starts = np.zeros(len(piece.data) + 1, np.int64)
    np.cumsum((piece.data & 0xC0) != 0x80, out=starts[1:])
    return _Distinct(inverse, np.stack(cells, 1), first, scripts_of(data, start), (starts[w.end] - starts[w.start])[index])


def _count(batches):
    """Feature counts (int64 x _TABLE) and script counts of each language of a partition, as bytes."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        for piece in B.slices(batch.column("text")):
            w = B.words(piece, LETTERS)
            if not len(w.hash):
                continue
            words = _distinct(piece, w)
            owner = np.repeat(np.arange(piece.n), w.count())
            names = [lang[piece.first + d] for d in range(piece.n)]
            for name in set(names):
                mine = np.array([x == name for x in names])[owner]
                times = np.bincount(words.inverse[mine], minlength=len(words.first))
                per_cell = np.repeat(times, np.diff(np.append(words.first, len(words.cells))))
                row = totals.setdefault(name, np.zeros(_TABLE + len(_NAMES), np.int64))
                for s in range(len(_SIZES)):
                    row[:_TABLE] += np.bincount(words.cells[:, s], per_cell, _TABLE).astype(np.int64)
                row[_TABLE:] += np.bincount(words.script, times, len(_NAMES)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["lang", "counts"])


def _added(key, group):
    total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})


@dataclass
class Model:
    """languages: sorted; weights: (_TABLE, languages) log probabilities; allowed: (scripts, languages); default: the commonest."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray
    default: int


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from rows (doc_id, text, lang); null texts and langs are skipped. Eager.

    About ``rows`` rows are read, by a hash of doc_id; what reaches the driver is one table of fixed size for
    each language.
    """
    B.bounded_batches(labelled.sparkSession)
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * rows / n) + 1)
    counted = known.select("lang", "text").repartition(_TRAIN_PARTS).mapInArrow(_count, "lang string, counts binary").groupBy("lang").applyInArrow(_added, "lang string, counts binary")
    table = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in counted.collect())
    if not table:
        return Model([], np.zeros((_TABLE, 0), np.float32), np.zeros((len(_NAMES), 0), bool), -1)
    counts = np.stack([c for _, c in table], 1)
    cells, scripts = counts[:_TABLE] + 0.5, counts[_TABLE:]
    share = scripts / np.maximum(scripts.sum(0), 1)
    return Model([x for x, _ in table], np.log(cells / cells.sum(0)).astype(np.float32), share >= SCRIPT_SHARE, int(scripts.sum(0).argmax()))


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best state of every word. score: (words, states); first: first word of each text (n + 1 entries).

    All texts of a slice advance together, word by word, the longest first in memory.
    """
    states = score.shape[1]
    length = np.diff(first)
    by = np.argsort(-length, kind="stable")
    begin, length = first[:-1][by], length[by]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")
    out = np.zeros(len(score), np.int16)
    if states < 2 or not longest:
        return out
    stay, best = np.zeros(score.shape, bool), np.zeros(len(score), np.int16)
    value = score[begin[: active[0]]]
    last = value.argmax(1).astype(np.int16)
    for t in range(1, longest):
        k = active[t]
        at, value = begin[:k] + t, value[:k]
        top = value.argmax(1)
        moved = value[np.arange(k), top] - switch
        stay[at] = value >= moved[:, None]
        best[at] = top
        value = score[at] + np.maximum(value, moved[:, None])
        last[:k] = value.argmax(1)
    state = np.zeros(0, np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        if len(state):
            after = begin[: len(state)] + t + 1
            state = np.where(stay[after, state], state, best[after])
        state = np.concatenate([state, last[len(state) : k]])
        out[begin[:k] + t] = state
    return out


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def label_slice(piece: B.Slice, model: Model) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, list, list]:
    """Label (or None), score, share of all languages, number of spans, and (lang, words) of the spans of each text of a slice."""
    w = B.words(piece, LETTERS)
    n, states = piece.n, len(model.languages)
    labels: list = [None] * n
    share, known_share, n_spans = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    langs: list = [[] for _ in range(n)]
    counts: list = [[] for _ in range(n)]
    if not len(w.hash) or not states:
        return labels, share, known_share, n_spans, langs, counts
    words = _distinct(piece, w)
    summed = np.add.reduceat(sum(model.weights[words.cells[:, s]] for s in range(len(_SIZES))), words.first, axis=0)
    allowed = model.allowed[words.script]
    summed = np.where(allowed, summed, -np.inf)
    top = summed.max(1, keepdims=True)
    score = np.where(np.isfinite(top), np.maximum(summed - np.where(np.isfinite(top), top, 0), -CLIP), 0).astype(np.float32)
    state = viterbi(score[words.inverse], w.first, SWITCH)
    known = allowed.any(1)[words.inverse]
    owner = np.repeat(np.arange(n), w.count())
    letters = words.letters[words.inverse]
    mass = np.bincount(owner * states + state, letters * known, n * states).reshape(n, states)
    total = np.bincount(owner, letters, n)
    cut = np.ones(len(state), bool)
    cut[1:] = (state[1:] != state[:-1]) | (owner[1:] != owner[:-1])
    cut = np.flatnonzero(cut)
    runs = np.diff(np.append(cut, len(state)))
    for i, c in zip(cut.tolist(), runs.tolist()):
        langs[owner[i]].append(model.languages[state[i]])
        counts[owner[i]].append(c)
    n_spans = np.bincount(owner[cut], minlength=n)
    ascii_letter = np.zeros(n, bool)
    ascii_letter[np.searchsorted(piece.off, np.flatnonzero(LETTERS[piece.data] & (piece.data < 0x80)), "right") - 1] = True
    for d in range(n):
        a, b = piece.off[d], piece.off[d + 1]
        if ascii_letter[d] or (total[d] and has_letter(piece.data[a:b].tobytes())):
            best = int(mass[d].argmax()) if mass[d].any() else model.default
            labels[d] = model.languages[best]
            share[d], known_share[d] = mass[d, best] / max(total[d], 1), mass[d].sum() / max(total[d], 1)
    return labels, share, known_share, n_spans, langs, counts


def _label(model: Model, keep: tuple[str, ...], names: list[str]):
    def run(batches):
        for batch in batches:
            for piece in B.slices(batch.column("__text")):
                labels, share, known, n_spans, langs, counts = label_slice(piece, model)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column("__text" if c == "text" else c).slice(piece.first, piece.n) for c in keep), pa.array([x or UNDETERMINED for x in labels]), pa.array(share), pa.array(known), pa.array(n_spans, pa.int64()), pa.array(langs, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
                    [*keep, *names],
                )

    return run


_LABELS = {"lang_pred": "string", "score": "double", "known": "double", "n_spans": "bigint", "span_langs": "array<string>", "span_words": "array<int>"}


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The ``keep`` columns and lang_pred, score, known, n_spans, span_langs, span_words of each row of docs.

    prefix goes before the new names, where docs has columns called so. score: the share of the letters in words of
    lang_pred, known: in words of any learned language.

    lang_pred: a learned language, or ``und`` if the text is null or has no letter (score 0, no spans). A text
    with letters of unlearned scripts only gets the commonest learned language with score 0. Only the text is
    read for a prediction; ties go to the language that sorts first.
    """
    B.bounded_batches(docs.sparkSession)
    schema = schema_with(docs, keep, ", ".join(f"{prefix}{name} {kind}" for name, kind in _LABELS.items()))
    return docs.select(*(F.col(f"`{c}`") for c in keep if c != "text"), F.col("text").alias("__text")).mapInArrow(_label(model, keep, [prefix + name for name in _LABELS]), schema)


def held_out(doc_id="doc_id", mod: int = 5, remainder: int = 0):
    """True for rows that training must not see: crc32 of the id as text, modulo."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == remainder, F.lit(False))


def language_report(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans): learned from rows that are not held out, predicted for all."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"), rows)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def only_identified(docs: DataFrame, least: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without texts that have no language, or less than ``least`` of their letters in learned ones; columns stay.

    A text that mixes learned languages stays, in whatever shares. Without a single labelled row there is no model
    to reject anything by, and all of docs stays.
    """
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"), rows)
    if not model.languages:
        return docs
    narrow, back = apart(docs, "doc_id", "text")
    found = identify(narrow, model, keep=tuple(narrow.columns), prefix="__")
    return back(found.where((F.col("__lang_pred") != UNDETERMINED) & (F.col("__known") >= least)))
