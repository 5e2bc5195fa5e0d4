"""Exact substring deduplication with threshold-bounded expansion of suffix intervals.

A byte is removed if a string of ``least`` bytes that covers it also starts anywhere else. The work is cut into
independent pieces by content, without loss:

1. Every window of ``least`` bytes picks an anchor, its smallest hash of GRAM consecutive bytes (the leftmost
   of equal ones). Equal windows pick equal anchors, so only windows whose anchors have one hash can be equal.
   Consecutive windows with one anchor are one context: their bytes, a few hundred, and each window of a text
   is in exactly one context.
2. Anchors whose hash occurs once end here. Contexts that are byte for byte the same are one class; a group
   that is a single class of several contexts is repeated as a whole.
3. The classes of every other group meet in one task, which sorts the suffixes of their bytes, forms the
   Burrows-Wheeler transform, and expands its intervals backward, breadth first: a border between suffixes
   gets its common prefix length when an interval first ends there, in increasing order, up to ``least``.
   Borders that are still open then have common prefixes of ``least`` bytes or more; the windows beside them
   are repeated.

Contexts of exact copies collapse before any text is moved, so a group of thousands of copies costs one class.

Passages counted in words (``remove_passages``) go the same way up to step 2, with windows and grams of words;
step 3 then counts the hashes of the windows of the classes, which are few, in a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import apart, schema_with, settle, small

GRAM = 100
WORD_GRAM = 12
PACKED = 7
SORT_BYTES = 1 << 19
SORT_CLASSES = 6000
_ODD = 0x9E3779B97F4A7C15
_TOP = np.uint64(0xFFFFFFFF00000000)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on (those that run over the end are meaningless)."""
    return rolled(B.keyed(256, 31)[data], k)


def rolled(power: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on (those that run over the end are meaningless)."""
    n = len(power)
    with np.errstate(over="ignore"):
        out, done, size = None, 0, 1
        while k:
            if k & 1:
                if out is None:
                    out = power.copy()
                else:
                    out *= np.uint64(pow(_ODD, size, 1 << 64))
                    out[: max(0, n - done)] += power[done:]
                done += size
            k >>= 1
            if k:
                more = power * np.uint64(pow(_ODD, size, 1 << 64))
                more[: max(0, n - size)] += power[size:]
                power, size = more, size * 2
        return B.mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] at each i (shorter at the end)."""
    now, n, size = x.copy(), len(x), 1
    while size * 2 <= width:
        if size < n:
            now[: n - size] = np.minimum(now[: n - size], now[size:])
        size *= 2
    if (rest := width - size) and rest < n:
        now[: n - rest] = np.minimum(now[: n - rest], now[rest:])
    return now


def anchors(piece: B.Slice, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a slice: text, first window (byte in the slice), number of windows, hash of the anchor."""
    return contexts(gram_hashes(piece.data, gram), piece.off, least, gram)


def contexts(h: np.ndarray, off: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchors() of texts that are off[i] to off[i + 1] of a row of bytes or words with gram hashes h."""
    windows = np.maximum(np.diff(off) - least + 1, 0)
    at = B.ranges(off[:-1], windows)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64)
    place = sliding_min((h & _TOP) | np.arange(len(h), dtype=np.uint64), least - gram + 1)[at] & ~_TOP
    text = np.repeat(np.arange(len(off) - 1), windows)
    first = np.ones(len(at), bool)
    first[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(first)
    return text[first], at[first], np.diff(np.append(first, len(at))), h[place[first].astype(np.int64)]


def _find_anchors(least: int, gram: int, by_word: bool = False):
    """Rows (h, c, d, k, lo, more, n): a context's anchor and digest, its first window in a text, and further ones.

    A text that repeats one pattern has very many equal contexts; they are one row. by_word: least, gram, lo and
    n count words instead of bytes.
    """

    def run(batches):
        for batch in batches:
            d, k = batch.column("d"), batch.column("k")
            for piece in B.slices(batch.column("text")):
                if by_word:
                    w = B.words(piece, B.WORD_BY_SPACE, lower=False)
                    data, off = w.hash, w.first
                    text, start, count, h = contexts(rolled(data, gram), off, least, gram)
                else:
                    data, off = piece.data, piece.off
                    text, start, count, h = anchors(piece, least, gram)
                raw = memoryview(np.ascontiguousarray(data))
                digest = b"".join(hashlib.blake2b(raw[s : s + c + least - 1], digest_size=8).digest() for s, c in zip(start.tolist(), count.tolist()))
                c = np.frombuffer(digest, np.int64)
                by = np.lexsort((start, c, h, text))
                text, start, count, h, c = text[by], start[by], count[by], h[by], c[by]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(text)))
                lo = start - off[text]
                offsets = np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32)
                more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lo[~new]), mask=pa.array(size == 1))
                rows = pa.array(text[first] + piece.first)
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(h[first])), pa.array(c[first]), d.take(rows), k.take(rows), pa.array(lo[first]), more, pa.array(count[first])], ["h", "c", "d", "k", "lo", "more", "n"])

    return run


def _extract(least: int):
    """Rows (text, wanted: h, c, copies, lo, n): the bytes of each wanted context."""

    def run(batches):
        for batch in batches:
            texts, wanted = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()
            h, c, copies, body = [], [], [], []
            for text, asked in zip(texts, wanted):
                for w in asked:
                    h.append(w["h"])
                    c.append(w["c"])
                    copies.append(w["copies"])
                    body.append(text[w["lo"] : w["lo"] + w["n"] + least - 1])
                    if len(h) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(copies), pa.array(body, pa.binary())], ["h", "c", "copies", "body"])
                        h, c, copies, body = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(copies, pa.int64()), pa.array(body, pa.binary())], ["h", "c", "copies", "body"])

    return run


def packed(symbols: np.ndarray) -> np.ndarray:
    """The first PACKED symbols (0 to 256) of every suffix as one number, zeros after the end."""
    n = len(symbols)
    key = symbols.astype(np.int64)

    def after(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if by < n:
            out[: n - by] = x[by:]
        return out

    two = (key << 9) | after(key, 1)
    four = (two << 18) | after(two, 2)
    return (four << 27) | (after(four, 4) >> 9)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols (0 to 256); what follows the end sorts first.

    Ranks are numbers of places, so a suffix that shares its rank with no other is done; only the others are sorted
    again, by the ranks of two or three parts that follow each other.
    """
    n = len(symbols)
    key = packed(symbols)
    known = PACKED
    order = np.argsort(key)
    key = key[order]
    rank = np.zeros(n + 1, np.int64)
    slots, at = np.arange(n), order
    parts, bits = (3, 21) if n < 1 << 21 else (2, 31)
    while True:
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[at] = np.repeat(slots[first[:-1]] + 1, np.diff(first))
        tied = ~(new[:-1] & new[1:])
        slots, at = slots[tied], at[tied]
        if known >= depth or not len(at):
            return order
        key = rank[at]
        for i in range(1, parts):
            key = (key << bits) | rank[np.minimum(at + i * known, n)]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        known *= parts


def open_borders(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """True at border i if suffixes order[i - 1] and order[i] share ``least`` symbols or more.

    Breadth-first backward extension: the interval of a string w, whose right border has just received the
    length |w| - 1, is extended by every symbol that precedes it in the Burrows-Wheeler transform; an extension
    that ends at a border without a length gives it |w| and stays in the queue. The first strings have PACKED
    symbols; borders with fewer common ones show in packed(). Intervals are in ascending order, so a stable sort
    by the preceding symbol alone keeps them so. Symbol 0 ends a text: strings with more after it are not
    followed, and a border is only right if one of its suffixes has no 0 in its first ``least`` symbols.
    """
    n, known = len(symbols), min(PACKED, least)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    previous = np.where(order > 0, order - 1, n - 1)
    back, transform = place[previous], symbols[previous]
    key = packed(symbols)[order] >> (9 * (PACKED - known))
    is_open = np.zeros(n + 1, bool)
    is_open[1:n] = key[1:] == key[:-1]
    edge = np.flatnonzero(~is_open).astype(np.int32)
    low, high = edge[:-1], edge[1:]
    fresh = np.append(key[high[:-1] - 1] >> 9 == key[high[:-1]] >> 9, False)
    low, high = low[fresh], high[fresh]
    for _ in range(known, least):
        size = high - low
        group = np.repeat(np.arange(len(low), dtype=np.int32), size)
        at = np.arange(len(group), dtype=np.int32) + (low - (np.cumsum(size, dtype=np.int32) - size))[group]
        symbol = transform[at]
        by = np.argsort(symbol, kind="stable")[len(symbol) - np.count_nonzero(symbol) :]
        if not len(by):
            break
        group, symbol, target = group[by], symbol[by], back[at[by]]
        cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])]))
        left = np.minimum.reduceat(target, cut)
        right = left + np.diff(np.append(cut, len(group))).astype(np.int32)
        new = is_open[right]
        low, high = left[new], right[new]
        is_open[high] = False
    return is_open


def repeated_windows(bodies: list[bytes], copies: list[int], least: int) -> list[np.ndarray]:
    """For each context, which of its windows occurs again among the contexts given."""
    length = np.array([len(b) + 1 for b in bodies])
    start = np.cumsum(length) - length
    symbols = np.zeros(int(length.sum()), np.int16)
    for s, b in zip(start.tolist(), bodies):
        symbols[s : s + len(b)] = np.frombuffer(b, np.uint8).astype(np.int16) + 1
    order = suffix_order(symbols, least)
    beside = open_borders(symbols, order, least)
    again = np.zeros(len(symbols), bool)
    again[order] = beside[:-1] | beside[1:]
    # one body stands for all copies of a context, whose windows all occur again
    return [again[s : s + len(b) - least + 1] | (c > 1) for s, b, c in zip(start.tolist(), bodies, copies)]


def _expand(least: int):
    """Contexts sorted by h, each class once or more: the repeated windows (from, to) of each class."""

    def solve(h, c, copies, body):
        found = repeated_windows(body, copies, least)
        starts, ends = [], []
        for flags in found:
            edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
            starts.append(np.flatnonzero(edge == 1).tolist())
            ends.append(np.flatnonzero(edge == -1).tolist())
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["h", "c", "starts", "ends"])

    def run(batches):
        h, c, copies, body, size, seen = [], [], [], [], 0, set()
        for batch in batches:
            for x, y, m, text in zip(batch.column("h").to_pylist(), batch.column("c").to_pylist(), batch.column("copies").to_pylist(), batch.column("body").to_pylist()):
                if h and x != h[-1]:
                    seen = set()
                    if size >= SORT_BYTES:
                        yield solve(h, c, copies, body)
                        B.trim()
                        h, c, copies, body, size = [], [], [], [], 0
                if y in seen:
                    continue
                seen.add(y)
                h.append(x)
                c.append(y)
                copies.append(m)
                body.append(text)
                size += len(text)
        if h:
            yield solve(h, c, copies, body)
            B.trim()

    return run


def _merged(lo: list[int], hi: list[int]) -> tuple[list[int], list[int]]:
    lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist()


def _merge():
    """Rows (d, k, lo, hi lists): the lists merged to disjoint spans, in order."""

    def run(batches):
        for batch in batches:
            starts, ends = [], []
            for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
                lo, hi = _merged(lo, hi)
                starts.append(lo)
                ends.append(hi)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("k"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["d", "k", "starts", "ends"])

    return run


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1))).withColumn("__k", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, least: int = 400, gram: int = GRAM) -> DataFrame:
    """(d, k, starts, ends): byte spans of each text that are covered by repeated strings of ``least`` bytes.

    d, k: coalesce(doc_id, -1) and xxhash64(text), which rows with equal texts and ids share, as they share
    their spans. Texts without such a span have no row. Eager.
    """
    if least <= gram:
        raise ValueError(f"least must be more than gram ({gram})")
    B.bounded_batches(docs.sparkSession)
    keyed = with_key(docs).where(F.octet_length("text") >= least).select(F.col("__d").alias("d"), F.col("__k").alias("k"), "text")
    bodies = lambda asked: asked.mapInArrow(_extract(least), "h bigint, c bigint, copies bigint, body binary")
    # the suffix stage is heavy for its bytes, so its partitions follow the number of contexts
    solve = lambda asked, n: (
        bodies(asked).repartition(1 + n // SORT_CLASSES, "h").sortWithinPartitions("h").mapInArrow(_expand(least), "h bigint, c bigint, starts array<bigint>, ends array<bigint>").where(F.size("starts") > 0)
    )
    return _spans(keyed, _find_anchors(least, gram), solve, least)


def repeated_passages(docs: DataFrame, words: int, gram: int = WORD_GRAM) -> DataFrame:
    """(d, k, starts, ends) as of repeated_spans(), in words: what repeated runs of ``words`` words cover.

    Words stand between ASCII white space; which white space does not matter, case does. Eager.
    """
    if words <= gram:
        raise ValueError(f"words must be more than gram ({gram})")
    B.bounded_batches(docs.sparkSession)
    keyed = with_key(docs).where(F.octet_length("text") >= 2 * words - 1).select(F.col("__d").alias("d"), F.col("__k").alias("k"), "text")

    def solve(asked: DataFrame, n: int) -> DataFrame:
        rows = settle(asked.mapInArrow(_windows(words), "h bigint, c bigint, copies bigint, at bigint, w bigint"))
        again = rows.groupBy("h", "w").agg(F.sum("copies").alias("times")).where("times > 1").select("h", "w")
        held = rows.join(again, ["h", "w"], "left_semi").groupBy("h", "c").agg(F.collect_list("at").alias("starts"))
        return held.withColumn("ends", F.transform("starts", lambda x: x + 1))

    return _spans(keyed, _find_anchors(words, gram, by_word=True), solve, words)


def _windows(least: int):
    """Rows (text, wanted: h, c, copies, lo, n): the hash of every window of each wanted context of words."""

    def run(batches):
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for piece in B.slices(batch.column("text")):
                w = B.words(piece, B.WORD_BY_SPACE, lower=False)
                hashes = rolled(w.hash, least)
                asked = [(x["h"], x["c"], x["copies"], x["lo"] + f, x["n"]) for f, xs in zip(w.first.tolist(), wanted[piece.first : piece.first + piece.n]) for x in xs]
                h, c, copies, lo, n = np.array(asked, np.int64).reshape(-1, 5).T
                at = B.ranges(lo, n)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, n)) for x in (h, c, copies)), pa.array(at - np.repeat(lo, n)), pa.array(B.signed(hashes[at]))], ["h", "c", "copies", "at", "w"])

    return run


def _spans(keyed: DataFrame, find, solve, least: int) -> DataFrame:
    """Spans of (d, k, text) from its contexts (find) and, of (text, wanted) and their number, the repeated windows of classes (solve)."""
    found = settle(keyed.mapInArrow(find, "h bigint, c bigint, d bigint, k bigint, lo bigint, more array<bigint>, n bigint"))
    times = F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0)))
    groups = found.groupBy("h").agg(times.alias("times"), F.min("c").alias("c_low"), F.max("c").alias("c_high")).where("times > 1")
    again = settle(found.join(groups.select("h", (F.col("c_low") == F.col("c_high")).alias("whole")), "h"))
    every = F.when(F.col("more").isNull(), F.array("lo")).otherwise(F.concat(F.array("lo"), "more"))
    whole = again.where("whole").select("d", "k", every.alias("lo"), F.transform(every, lambda x: x + F.col("n") + (least - 1)).alias("hi"))
    open_ = again.where("NOT whole")
    classes = open_.groupBy("h", "c").agg(times.alias("copies"), F.min(F.struct("d", "k", "lo", "n")).alias("at"))
    wanted = settle(
        classes.groupBy(F.col("at.d").alias("d"), F.col("at.k").alias("k")).agg(F.collect_list(F.struct("h", "c", "copies", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"))).alias("wanted"))
    )
    n_classes = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    solved = solve(keyed.join(small(wanted, n_classes), ["d", "k"]).select("text", "wanted"), n_classes)
    placed = lambda ends, by: F.flatten(F.transform("los", lambda x: F.transform(ends, lambda w: x + w + by)))
    parts = open_.join(solved, ["h", "c"]).select("d", "k", every.alias("los"), "starts", "ends").select("d", "k", placed("starts", 0).alias("lo"), placed("ends", least - 1).alias("hi"))
    gathered = whole.unionByName(parts).distinct().groupBy("d", "k").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    return settle(gathered.mapInArrow(_merge(), "d bigint, k bigint, starts array<bigint>, ends array<bigint>"))


def attach(docs: DataFrame, spans: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """docs with __starts, __ends and extra columns from spans (d, k, starts, ends, ...), null where a text has none."""
    n, total = spans.agg(F.count("*"), F.sum(F.size("starts"))).first()
    right = small(spans, max(n, (total or 0) // 4))
    right = right.select(F.col("d").alias("__d"), F.col("k").alias("__k"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"), *extra)
    return with_key(docs).join(right, ["__d", "__k"], "left")


def _keep(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def _digests(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        kept = [_keep(t or b"", s or [], e or []) for t, s, e in zip(texts, starts, ends)]
        size = [len(t or b"") for t in texts]
        columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array([n - len(x) for n, x in zip(size, kept)], pa.int64()), pa.array([len(s or []) for s in starts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if "n_repeated" in batch.schema.names:
            columns.append(batch.column("n_repeated"))
            names.append("n_repeated")
        if "__first" in batch.schema.names:
            both = (_with_passages(*r)[1:] for r in zip(texts, starts, ends, batch.column("__first").to_pylist(), batch.column("__last").to_pylist()))
            columns.append(pa.array([sum(e or ()) - sum(s or ()) for s, e in both], pa.int64()))
            names.append("n_repeated")
        yield pa.RecordBatch.from_arrays(columns, names)


def substring_report(docs: DataFrame, least: int = 400, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty. A row that repeats
    another, id included, is a copy like any other: all its repeated bytes go. With words, n_repeated follows: the
    bytes that these strings and repeated passages of ``words`` words cover, which takes nothing more out.
    """
    docs = docs.select("doc_id", "text")
    return digests(docs, repeated_spans(docs, least, gram)) if words is None else digests(docs, _with_words(docs, words, least), ("__first", "__last"))


def digests(docs: DataFrame, spans: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """substring_report()'s columns for texts without the given spans; n_repeated from a column of spans so called, or word spans."""
    counted = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) if c == "n_repeated" else F.col(c) for c in extra]
    joined = attach(docs, spans, extra).select("doc_id", "text", F.col("__starts").alias("starts"), F.col("__ends").alias("ends"), *counted)
    return joined.mapInArrow(_digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", n_repeated bigint" if extra else ""))


def _with_passages(text: bytes | None, starts: list[int] | None, ends: list[int] | None, first: list[int] | None, last: list[int] | None):
    """Byte spans (text, starts, ends) with those of the words first to last (exclusive) added."""
    if not first:
        return text, starts, ends
    edge = np.diff(np.concatenate([[0], B.WORD_BY_SPACE[np.frombuffer(text, np.uint8)].astype(np.int8), [0]]))
    low, high = np.flatnonzero(edge == 1)[first], np.flatnonzero(edge == -1)[np.array(last) - 1]
    return text, *_merged([*(starts or []), *low.tolist()], [*(ends or []), *high.tolist()])


def _rewrite(batches):
    for batch in batches:
        names = ["__starts", "__ends", *(c for c in ("__first", "__last") if c in batch.schema.names)]
        rows = zip(batch.column("__text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in names))
        rows = (_with_passages(*r) for r in rows) if len(names) == 4 else rows
        text = [None if t is None else (_keep(t, s, e) if s else t).decode("utf-8", "ignore") for t, s, e in rows]
        rest = [c for c in batch.schema.names if not c.startswith("__")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(text, pa.string())], [*rest, "__new"])


def remove_repeats(docs: DataFrame, least: int = 400, gram: int = GRAM) -> DataFrame:
    """docs without its repeated strings of ``least`` bytes; every row and every other column stay.

    Removal is in bytes; what it leaves of a character that it cuts is dropped, so texts stay valid.
    """
    return without(docs, repeated_spans(docs, least, gram))


def remove_passages(docs: DataFrame, words: int, least: int = 400) -> DataFrame:
    """remove_repeats(), and repeated passages of ``words`` words, however short, go too."""
    return without(docs, _with_words(docs, words, least), ("__first", "__last"))


def _with_words(docs: DataFrame, words: int, least: int) -> DataFrame:
    """repeated_spans(), with __first and __last, the word spans of repeated_passages()."""
    none = F.lit(None).cast("array<bigint>")
    in_bytes = repeated_spans(docs, least).select("d", "k", "starts", "ends", none.alias("__first"), none.alias("__last"))
    in_words = repeated_passages(docs, words).select("d", "k", none.alias("starts"), none.alias("ends"), F.col("starts").alias("__first"), F.col("ends").alias("__last"))
    both = in_bytes.unionByName(in_words).groupBy("d", "k").agg(*(F.coalesce(F.first(c, ignorenulls=True), F.array().cast("array<bigint>")).alias(c) for c in ("starts", "ends", "__first", "__last")))
    return settle(both)


def without(docs: DataFrame, spans: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """docs with the given spans taken out of the text column."""
    narrow, back = apart(docs, "doc_id", "text")
    rest = [c for c in narrow.columns if c != "text"]
    schema = schema_with(narrow, rest, "__new string")
    joined = attach(narrow, spans, extra).select(*rest, F.col("text").alias("__text"), "__starts", "__ends", *extra)
    return back(joined.mapInArrow(_rewrite, schema).withColumnRenamed("__new", "text"))
