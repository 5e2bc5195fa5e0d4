"""MinHash near-duplicate detection with one-permutation hashing.

One hash of each shingle serves all bins: a bin keeps the smallest value that falls into it, and an empty bin
takes the value of the first occupied bin on a probe sequence of its own (optimal densification), so bins
collide with the Jaccard similarity as probability even for short texts. Bins are banded; texts that share a
band meet in a bucket, and a bucket proposes only the star from its smallest member.

A star can miss a link between two members that are both far from its centre. So links are found in two
steps, both confirmed on the full shingle sets: first the stars; then, only where the texts that buckets
connect still fall into several components, each text outside the largest component against the others of
its cluster, block by block, of which only a spanning forest is written. Texts with one shingle set are one
class from the start and never meet each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import apart, components, settle, small

BAND_ROWS = 6
#: Chance that no band of a pair exactly at the threshold agrees; the number of bands follows.
MISS = 1e-9
BLOCK = 128
_PROBES = 4096


def _sets(piece: B.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and the n + 1 borders between texts."""
    w = B.words(piece, B.WORD_BY_SPACE)
    gram = B.grams(w.hash, k)
    out, border = [], np.zeros(piece.n + 1, np.int64)
    for d in range(piece.n):
        a, b = w.first[d], w.first[d + 1]
        if b - a >= k:
            found = np.unique(gram[a : b - k + 1])
        elif b > a:
            found = B.grams(w.hash[a:b], int(b - a), seed=7)
        else:
            found = gram[:0]
        out.append(found)
        border[d + 1] = border[d] + len(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), border


def signatures(sets: np.ndarray, border: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures (texts x bins) with optimal densification; no text may have an empty set."""
    n = len(border) - 1
    size = np.diff(border)
    doc = np.repeat(np.arange(n), size)
    h = B.mix64(sets)
    cell = doc * bins + ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    keep = np.ones(len(cell), bool)
    keep[1:] = cell[1:] != cell[:-1]
    sig = np.zeros(n * bins, np.uint64)
    full = np.zeros(n * bins, bool)
    sig[cell[keep]] = h[keep]
    full[cell[keep]] = True
    empty = np.flatnonzero(~full)
    row, bin_ = (empty // bins) * bins, (empty % bins).astype(np.uint64)
    attempt = 0
    while len(empty):
        if attempt < _PROBES:
            probe = B.mix64(bin_ * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)
        else:  # walk on from the bin itself, which must end
            probe = (bin_ + np.uint64(attempt)) % np.uint64(bins)
        source = row + probe.astype(np.int64)
        hit = full[source]
        sig[empty[hit]] = sig[source[hit]]
        empty, row, bin_ = empty[~hit], row[~hit], bin_[~hit]
        attempt += 1
    return sig.reshape(n, bins)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts x bands) bucket keys; the band's number is part of the key."""
    c = B.keyed(rows, 23) | np.uint64(1)
    part = sig.reshape(len(sig), bands, rows)
    key = np.zeros(part.shape[:2], np.uint64)
    for j in range(rows):
        key += B.mix64(part[:, :, j] + c[j])
    return B.mix64(key + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bands_for(percent: int, rows: int = BAND_ROWS) -> int:
    """Bands that a pair at the threshold shares one of, but for a chance of MISS."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - min(percent / 100, 0.999) ** rows)))


def _least_linkable(percent: int) -> int:
    """Smaller sets than this link with no set but an equal one: n / (n + 1) stays below the threshold."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def digests(sets: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set: sums of its hashes, plain and mixed."""
    out = []
    for x in (sets, B.mix64(sets + np.uint64(77))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        out.append(total[border[1:]] - total[border[:-1]])
    return out[0], out[1]


def _sketch(k: int, bands: int, rows: int, least: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for piece in B.slices(batch.column("text")):
                sets, border = _sets(piece, k)
                size = np.diff(border)
                d1, d2 = digests(sets, border)
                some = np.flatnonzero(size >= least)
                count = np.zeros(piece.n, np.int64)
                count[some] = bands
                keys = np.zeros((0, bands), np.uint64)
                if len(some):
                    at = B.ranges(border[some], size[some])
                    keys = band_keys(signatures(sets[at], np.concatenate([[0], np.cumsum(size[some])]), bands * rows), bands, rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(piece.first, piece.n), pa.array(size), pa.array(B.signed(d1)), pa.array(B.signed(d2)), pa.ListArray.from_arrays(offsets, pa.array(B.signed(keys.ravel())))],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for piece in B.slices(batch.column("text")):
                sets, border = _sets(piece, k)
                d1, d2 = digests(sets, border)
                body = pa.array([sets[border[d] : border[d + 1]].tobytes() for d in range(piece.n)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(piece.first, piece.n), pa.array(B.signed(d1)), pa.array(B.signed(d2)), body], ["id", "d1", "d2", "shingles"])

    return run


def _linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _confirm(percent: int):
    """Rows (a, b, left, right): the pairs whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                short, long_ = min(len(x), len(y)), max(len(x), len(y))
                keep.append(100 * short >= percent * long_ and _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Intersection sizes of every left set with every right set, by products of 0/1 matrices."""
    sizes_l, sizes_r = [len(x) for x in left], [len(x) for x in right]
    codes, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row_l, row_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    at_l, at_r = at[: len(row_l)], at[len(row_l) :]
    both = np.zeros(len(codes), bool)
    both[at_l] = True
    seen = np.zeros(len(codes), bool)
    seen[at_r] = True
    both &= seen
    place = np.cumsum(both) - 1
    keep_l, keep_r = both[at_l], both[at_r]
    row_l, col_l, row_r, col_r = row_l[keep_l], place[at_l[keep_l]], row_r[keep_r], place[at_r[keep_r]]
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(both.sum()), columns):
        x, y = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        m = (col_l >= low) & (col_l < low + columns)
        x[row_l[m], col_l[m] - low] = 1
        m = (col_r >= low) & (col_r < low + columns)
        y[row_r[m], col_r[m] - low] = 1
        total += x @ y.T
    return total.astype(np.int64)


def _block_links(percent: int):
    """One block of outliers against one block of its cluster: a spanning forest of the links found."""

    def run(key, group):
        ids, component = group.column("id").to_numpy(), group.column("component").to_numpy()
        outlier = group.column("outlier").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        left, right = np.flatnonzero(outlier), np.flatnonzero(~outlier)
        a, b = [], []
        if len(left) and len(right):
            n_l, n_r = np.array([len(sets[i]) for i in left]), np.array([len(sets[i]) for i in right])
            common = common_counts([sets[i] for i in left], [sets[i] for i in right])
            hit = (100 * common >= percent * (n_l[:, None] + n_r[None, :] - common)) & (component[left][:, None] != component[right][None, :])
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, j in np.argwhere(hit):
                x, y = find(int(component[left[i]])), find(int(component[right[j]]))
                if x != y:
                    root[x] = y
                    a.append(ids[left[i]])
                    b.append(ids[right[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    docs needs doc_id (bigint) and text; other columns are ignored. Shingles are k words, ASCII-lower-cased;
    a text of fewer words is one shingle. Two texts link if 100 * |intersection| >= percent * |union|.
    A null or empty text, or one without words, has no shingles and links with nothing. Rows that repeat a
    doc_id are one node, which has the links of all their texts. A row with null doc_id has component_id null and is kept. Eager: it runs jobs.
    """
    B.bounded_batches(docs.sparkSession)
    bands = bands_for(percent, rows)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    base = settle(docs.mapInArrow(_sketch(k, bands, rows, _least_linkable(percent)), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"))
    node = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = node.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # one row of a class, that of its smallest id, brings the bands
    reps = node.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").where(F.size("bands") > 0)
    buckets = settle(_shared(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))))
    stars = settle(buckets.where("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct())
    ends = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct()
    ends = settle(ends)
    sets = settle(docs.join(small(ends, ends.count()), "doc_id", "left_semi").mapInArrow(_full_sets(k), "id bigint, d1 bigint, d2 bigint, shingles binary").dropDuplicates(["id", "d1", "d2"]).drop("d1", "d2"))
    pairs = stars.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    linked = settle(pairs.select("a", "b", "left", "right").mapInArrow(_confirm(percent), "a bigint, b bigint"))

    first = settle(components(linked))
    more = _cross_links(first, buckets, stars, ends, sets, percent)
    final = _merged(first, more.unionByName(_same_id(node, classes)))

    classes = classes.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = base.join(classes, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _same_id(node: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the representatives of the classes of every doc_id that has several texts."""
    key = ["d1", "d2", "n_shingles"]
    several = node.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low != high").select("doc_id")
    own = node.select("doc_id", *key).join(several, "doc_id").join(classes, key).select("doc_id", "rep").distinct()
    return own.join(own.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where("rep != b").select(F.col("rep").alias("a"), "b").distinct()


def _shared(buckets: DataFrame) -> DataFrame:
    """(id, key, centre) of the buckets with two members or more."""
    centre = buckets.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("top")).where("centre != top").drop("top")
    return buckets.join(centre, "key")


def _between(edges: DataFrame, first: DataFrame) -> DataFrame:
    """The edges (a, b) that join different components of first, as edges between those components."""
    of = lambda x: first.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    placed = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    return placed.where("a != b").distinct()


def _merged(first: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of first and the ends of edges, when edges join components further."""
    over = components(_between(edges, first)).select(F.col("id").alias("component"), F.col("component").alias("top"))
    return settle(first.unionByName(over.select(F.col("component").alias("id"), "component")).join(over, "component", "left").select("id", F.coalesce("top", "component").alias("component")).distinct())


def _meetings(rows: DataFrame, *group: str) -> DataFrame:
    """For each group of rows (id, component) with several components: its largest, the numbers of blocks, how many
    copies of sets the blocks take, and two digests of the members."""
    digest = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
    sizes = rows.groupBy(*group, "component").agg(F.count("*").alias("count"), digest(1).alias("x"), digest(2).alias("y"))
    whole = sizes.groupBy(*group).agg(F.sum("count").alias("n"), F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("parts"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    out = F.col("n") - F.col("top.count")
    blocks, outlier_blocks = F.ceil(F.col("n") / BLOCK), F.ceil(out / BLOCK)
    return whole.where("parts > 1").select(*group, F.col("top.component").alias("major"), outlier_blocks.alias("outlier_blocks"), blocks.alias("blocks"), (out * blocks + F.col("n") * outlier_blocks).alias("copies"), "x", "y")


def _cross_links(first: DataFrame, buckets: DataFrame, stars: DataFrame, ends: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of one cluster (the components that stars of buckets connect).

    Texts that link share a bucket, so they meet either in each bucket (once, where buckets have equal members) or
    in the cluster as a whole, whichever takes fewer copies of sets there: chains of texts have small buckets,
    while a few strays of many alike texts share many buckets with all of them. Where they meet, every text outside
    the largest component meets every other, in blocks of about BLOCK each, so a task's size does not follow theirs.
    """
    clusters = components(_between(stars, first)).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    member = ends.select(F.col("doc_id").alias("id")).join(first, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    member = settle(member.join(clusters, "component").select("id", "cluster", "component"))
    in_keys = buckets.select("id", "key").join(member, "id")
    by_key = _meetings(in_keys, "cluster", "key")
    by_key = settle(by_key.groupBy("cluster", "x", "y").agg(F.min_by(F.struct("key", "major", "outlier_blocks", "blocks", "copies"), "key").alias("m")).select("cluster", "m.*"))
    sums = by_key.groupBy("cluster").agg(F.sum("copies").alias("key_copies"))
    whole = settle(_meetings(member, "cluster").join(sums, "cluster", "left").withColumn("together", F.coalesce(F.col("copies") <= F.col("key_copies"), F.lit(True))))
    plan = ("cluster", "major", "outlier_blocks", "blocks")
    in_key = by_key.join(whole.where("NOT together").select("cluster"), "cluster", "left_semi").select(*plan, "key")
    apart_ = buckets.select("id", "key").join(in_key, "key").join(member, ["id", "cluster"]).select("id", "component", *plan, "key")
    together = member.join(whole.where("together").select(*plan), "cluster").select("id", "component", *plan, F.lit(None).cast(buckets.schema["key"].dataType).alias("key"))
    placed = together.unionByName(apart_).join(sets, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    outliers = placed.where("component != major").select(
        "cluster", "key", F.pmod(F.xxhash64("id", F.lit(1)), F.col("outlier_blocks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("j"), "id", "component", "shingles", F.lit(True).alias("outlier")
    )
    others = placed.select("cluster", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outlier_blocks") - 1)).alias("i"), own.alias("j"), "id", "component", "shingles", F.lit(False).alias("outlier"))
    return settle(outliers.unionByName(others).groupBy("cluster", "key", "i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest doc_id; columns stay.

    Rows with equal doc_id and text are one document. Rows with null doc_id all stay. Eager.
    """
    if not docs.select("doc_id", F.xxhash64("text").alias("t")).groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    gone = settle(near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    narrow, back = apart(docs, "doc_id", "text")
    return back(narrow.join(small(gone, gone.count()), F.col("doc_id") == F.col("__gone"), "left_anti"))
