"""Benchmark decontamination by winnowing.

Of every WINDOW consecutive words, the K-gram with the smallest hash is a fingerprint, in documents and items
alike. A window that both share has the same K-grams, so both pick the same one: every shared window is found.
Fingerprints of documents are first held against a bitmap of the items' fingerprints, whose size is fixed
however large the benchmark is; what passes is joined with the items by hash, and each hit is extended to
both sides on the words themselves. Items shorter than a window are one window of their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import apart
from .substrings import sliding_min

WINDOW = 10
K = 5
_SIDE = WINDOW - K
_TOP = np.uint64(0xFFFFFFFF00000000)
#: Bits of the bitmap: 2 MB on every executor, for any benchmark.
BITMAP_BITS = 1 << 24


def winnow(w: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word position and hash of the fingerprints of all texts of a slice, ascending."""
    gram = B.grams(w.hash, K)
    at = B.ranges(w.first[:-1], np.maximum(w.count() - WINDOW + 1, 0))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    best = sliding_min((gram & _TOP) | np.arange(len(gram), dtype=np.uint64), WINDOW - K + 1)[at]
    place = (best & ~_TOP).astype(np.int64)
    fresh = np.ones(len(place), bool)
    fresh[1:] = place[1:] != place[:-1]
    place = place[fresh]
    return place, gram[place]


def short_grams(w: B.Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of m words inside a text: first word and hash."""
    gram = B.grams(w.hash, m, seed=100 + m)
    at = B.ranges(w.first[:-1], np.maximum(w.count() - m + 1, 0))
    return at, gram[at] if len(at) else np.zeros(0, np.uint64)


def _context(text: np.ndarray, w: B.Words, low: int, high: int) -> str:
    return b" ".join(text[w.start[i] : w.end[i]].tobytes() for i in range(low, high)).decode("utf-8", "replace")


def _items(batches):
    """Rows (item_id, fp, at, ctx, m): at: the fingerprint's place in the words of ctx; m: 0, or a short item's length."""
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        for piece in B.slices(batch.column("text")):
            w = B.words(piece, B.WORD_BY_ALNUM)
            text = B.LOWER[piece.data]
            rows = []
            place, fp = winnow(w)
            for p, f, d in zip(place.tolist(), B.signed(fp).tolist(), (np.searchsorted(w.first, place, "right") - 1).tolist()):
                low, high = max(int(w.first[d]), p - _SIDE), min(int(w.first[d + 1]), p + WINDOW)
                rows.append((ids[piece.first + d], f, p - low, _context(text, w, low, high), 0))
            for d, n in enumerate(w.count().tolist()):
                if 0 < n < WINDOW:
                    low = int(w.first[d])
                    f = int(B.signed(B.grams(w.hash[low : low + n], n, seed=100 + n))[0])
                    rows.append((ids[piece.first + d], f, 0, _context(text, w, low, low + n), n))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("item_id", "fp", "at", "ctx", "m"), r)) for r in rows],
                schema=pa.schema([("item_id", batch.schema.field("item_id").type), ("fp", pa.int64()), ("at", pa.int32()), ("ctx", pa.string()), ("m", pa.int32())]),
            )


def _slot(fp: np.ndarray) -> np.ndarray:
    return B.mix64(fp) & np.uint64(BITMAP_BITS - 1)


def _slots(batches):
    for batch in batches:
        slot = _slot(batch.column("fp").to_numpy().view(np.uint64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot)], ["slot"])


def _candidates(words_: np.ndarray, lengths: list[int]):
    """Rows of each document: one placeholder with its word count, and one per fingerprint that the bitmap lets pass."""

    def passes(fp: np.ndarray) -> np.ndarray:
        slot = _slot(fp)
        return np.flatnonzero((words_[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))

    def run(batches):
        for batch in batches:
            for piece in B.slices(batch.column("text")):
                w = B.words(piece, B.WORD_BY_ALNUM)
                found = []
                place, fp = winnow(w)
                for i in passes(fp).tolist():
                    found.append((int(place[i]), int(B.signed(fp[i : i + 1])[0]), 0))
                for m in lengths:
                    place, fp = short_grams(w, m)
                    for i in passes(fp).tolist():
                        found.append((int(place[i]), int(B.signed(fp[i : i + 1])[0]), m))
                doc = [piece.first + d for d in range(piece.n)]
                fps, pos, at, ctx, ms = [0] * piece.n, [0] * piece.n, [0] * piece.n, [None] * piece.n, [-1] * piece.n
                if found:
                    text = B.LOWER[piece.data]
                    owner = np.searchsorted(w.first, np.array([f[0] for f in found]), "right") - 1
                    for (p, f, m), d in zip(found, owner.tolist()):
                        first, last = int(w.first[d]), int(w.first[d + 1])
                        low, high = (max(first, p - _SIDE), min(last, p + WINDOW)) if m == 0 else (p, p + m)
                        doc.append(piece.first + d)
                        fps.append(f)
                        pos.append(p - first)
                        at.append(p - low)
                        ctx.append(_context(text, w, low, high))
                        ms.append(m)
                rows = pa.array(doc)
                n_words = w.count()[np.array(doc) - piece.first]
                key = batch.column("k").take(rows)
                # a placeholder is spread by its document's own hash and matches nothing, as no item has m = -1
                fp_column = np.where(np.array(ms) < 0, key.to_numpy(zero_copy_only=False), np.array(fps, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), key, pa.array(n_words, pa.int64()), pa.array(fp_column, pa.int64()), pa.array(pos, pa.int64()), pa.array(at, pa.int32()), pa.array(ctx, pa.string()), pa.array(ms, pa.int32())],
                    ["doc_id", "k", "n_words", "fp", "pos", "at", "ctx", "m"],
                )

    return run


def extend(doc: list[str], at: int, item: list[str], item_at: int, k: int) -> tuple[int, int]:
    """Length of the equal words before and from the fingerprint on; (0, 0) if the fingerprint itself differs."""
    right = 0
    while at + right < len(doc) and item_at + right < len(item) and doc[at + right] == item[item_at + right]:
        right += 1
    if right < k:
        return 0, 0
    left = 0
    while left < at and left < item_at and doc[at - left - 1] == item[item_at - left - 1]:
        left += 1
    return left, right


def _extended(batches):
    """Joined rows to hits: lo and hi are null where the row is no hit."""
    for batch in batches:
        lo, hi, ids = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("pos", "at", "ctx", "m", "i_at", "i_ctx", "item_ids")]
        for pos, at, ctx, m, i_at, i_ctx, item_ids in zip(*columns):
            left = right = 0
            if i_ctx is not None:
                left, right = extend(ctx.split(" "), at, i_ctx.split(" "), i_at, m or K)
            hit = left + right >= (m or WINDOW) if i_ctx is not None else False
            lo.append(pos - left if hit else None)
            hi.append(pos + right if hit else None)
            ids.append(item_ids if hit else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k"), batch.column("n_words"), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "k", "n_words", "lo", "hi", "item_ids"]
        )


def _key():
    return F.xxhash64(F.col("text"), F.col("doc_id").cast("bigint"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, k): the words of each document inside any occurrence of an item's window.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. items: sorted distinct
    item ids, as strings. Words are ASCII letters and digits (A-Z lower-cased) and all non-ASCII characters; a
    null text has none, and an item without words matches nothing. The words that an item with a null id hits
    count, but items has no id for it. A repeated row (the same
    id and text) is one document; k, the hash of its text, tells documents that share an id apart.
    """
    B.bounded_batches(docs.sparkSession)
    found = benchmark.select("item_id", "text").mapInArrow(_items, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, fp bigint, at int, ctx string, m int")
    items = found.groupBy("fp", "m", F.col("at").alias("i_at"), F.col("ctx").alias("i_ctx")).agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    # at most BITMAP_BITS / 64 words and WINDOW lengths reach the driver, for any benchmark
    packed = found.select("fp").mapInArrow(_slots, "slot bigint").groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    for row in packed.collect():
        bitmap[row["word"]] = row["bits"]
    lengths = [r["m"] for r in found.where("m > 0").select("m").distinct().collect()]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key().alias("k"), "text").mapInArrow(
        _candidates(bitmap.view(np.uint64), lengths), "doc_id bigint, k bigint, n_words bigint, fp bigint, pos bigint, at int, ctx string, m int"
    )
    hits = rows.join(items, ["fp", "m"], "left").select("doc_id", "k", "n_words", "pos", "at", "ctx", "m", "i_at", "i_ctx", "item_ids").mapInArrow(_extended, "doc_id bigint, k bigint, n_words bigint, lo bigint, hi bigint, item_ids array<string>")
    by_doc = hits.groupBy("doc_id", "k", "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("bigint"), x["hi"] - F.greatest(x["lo"], s["to"]))).alias("n"), F.greatest(s["to"], x["hi"]).alias("to")),
        lambda s: s["n"],
    )
    return by_doc.select("doc_id", "n_words", covered.alias("n_hit"), "items", "k")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document; see contamination()."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of an item; columns stay as they are."""
    narrow, back = apart(docs, "doc_id", "text")
    bad = contamination(docs, benchmark).where("n_hit > 0").select(F.col("k").alias("__k")).distinct()
    return back(narrow.withColumn("__k", _key()).join(bad, "__k", "left_anti"))
