"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(group | history) * P(class | group, history) * P(token | class). Both softmaxes have
hashed features of the history: the word before, the two words before together, and the word before that alone
(a skip). Classes are the commonest words, the end of a text, and hashed word endings; eight make a group. Inside
a class, tokens follow their counts with one added, over all training texts; unknown tokens share one count.

The weights are trained by rounds of distributed gradient updates: every partition of the training texts
descends from the current weights, and the changes are averaged over the partitions that touched a feature.
Partitions are those of the input, so their number follows its size; their changes are summed as they arrive, so
no task holds more than the table. Counts are summed in the shuffle, the most frequent tokens (a bounded table)
are sent to every task, and all other tokens meet their counts in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import settle
from .langid import held_out

#: Tokens whose counts go to every task, at most; the rest are joined.
HEAD_TOKENS = 1 << 18
ROUNDS = 2
#: Blocks of the weight table in which changes are averaged; the task of a block holds its changes from every partition.
BLOCKS = 256
_SINGLES = 31
_END_CLASS = _SINGLES
_ENDINGS = 32
CLASSES = _SINGLES + 1 + _ENDINGS
#: Classes of a group, and groups.
_SIDE = 8
FEATURES = 1 << 16
#: The weight table has a row of _SIDE weights for each feature's choice of a group, and for each of its groups.
_ROWS = FEATURES * (_SIDE + 1)
_END, _BEFORE = B.keyed(2, 91)
#: Tokens of an update: few at first, as the weights move most then.
_CHUNK, _LONG_CHUNK = 1 << 12, 1 << 16
_RATE = 0.25
_COUNT_FLUSH = 1 << 20


@dataclass
class Tokens:
    """Tokens of a slice, an end after each text's words; first: n + 1 entries."""

    hash: np.ndarray
    ending: np.ndarray
    first: np.ndarray


def tokens(piece: B.Slice) -> Tokens:
    w = B.words(piece, B.WORD_BY_SPACE)
    n = piece.n
    owner = np.repeat(np.arange(n), w.count())
    out = np.empty(len(w.hash) + n, np.uint64)
    ending = np.empty(len(out), np.int64)
    first = w.first + np.arange(n + 1)
    at = np.arange(len(w.hash)) + owner
    out[at] = w.hash
    out[first[1:] - 1] = _END
    data = B.LOWER[piece.data]
    if len(w.hash):
        last = data[w.end - 1].astype(np.uint64)
        before = np.where(w.end - w.start > 1, data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
        ending[at] = (B.mix64(last << np.uint64(8) | before) % np.uint64(_ENDINGS)).astype(np.int64)
    ending[first[1:] - 1] = -1
    return Tokens(out, ending, first)


def features(t: Tokens) -> np.ndarray:
    """(3, tokens) hashed features of each token's history."""
    one = np.empty_like(t.hash)
    one[1:], one[t.first[:-1]] = t.hash[:-1], _BEFORE
    two = np.empty_like(t.hash)
    two[1:], two[t.first[:-1]] = one[:-1], _BEFORE
    mask = np.uint64(FEATURES - 1)
    return np.stack([(B.mix64(x) & mask).astype(np.int64) for x in (one + np.uint64(1), two + np.uint64(2), one * np.uint64(3) + B.mix64(two))])


@dataclass
class Classes:
    """single: sorted hashes of words that are classes of their own; place: the class of each."""

    single: np.ndarray
    place: np.ndarray

    def of(self, t: Tokens) -> np.ndarray:
        out = np.where(t.ending < 0, _END_CLASS, _SINGLES + 1 + t.ending)
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, t.hash), len(self.single) - 1)
            hit = self.single[at] == t.hash
            out[hit] = self.place[at[hit]]
        return out


def _counts(batches):
    """(token, ending, c) of a partition, added up in memory until many are distinct."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        token = np.concatenate([x[0] for x in held])
        unique, first, inverse = np.unique(token, return_index=True, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([x[2] for x in held]), len(unique)).astype(np.int64)
        return unique, np.concatenate([x[1] for x in held])[first], count

    def row(x):
        return pa.RecordBatch.from_arrays([pa.array(B.signed(x[0])), pa.array(x[1]), pa.array(x[2])], ["token", "ending", "c"])

    for batch in batches:
        for piece in B.slices(batch.column("text")):
            t = tokens(piece)
            unique, first, count = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((unique, t.ending[first], count))
            size += len(unique)
            if size > _COUNT_FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > _COUNT_FLUSH // 2:
                    yield row(held[0])
                    held, size = [], 0
    if held:
        yield row(merged())


def choices(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens with features f and classes y, the choice of a group, then of a class in it.

    (3, 2 * tokens) rows of the weight table, the 2 * tokens rows of the bias, and what was chosen.
    """
    group = y // _SIDE
    first = f * (_SIDE + 1)
    return np.concatenate([first, first + 1 + group], 1), np.concatenate([np.zeros_like(group), 1 + group]), np.concatenate([group, y % _SIDE])


def _softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(_SIDE, choices) probabilities."""
    z = bias.take(own, 0)
    for at in rows:
        z += weights.take(at, 0)
    z = np.ascontiguousarray(z.T)
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def log_classes(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probability of each token's class."""
    rows, own, goal = choices(f, y)
    p = _softmax(weights, bias, rows, own)[goal, np.arange(len(goal))]
    return np.log(p).reshape(2, -1).sum(0)


def _descend(classes: Classes, weights: np.ndarray, bias: np.ndarray):
    """One partition's pass: the change of the weights and which rows it touched, in blocks of rows."""

    def run(batches):
        w, touched = weights.copy(), np.zeros(_ROWS, bool)
        total = np.full((_SIDE, _ROWS), 0.1, np.float32)
        size = _CHUNK
        for batch in batches:
            for piece in B.slices(batch.column("text")):
                t = tokens(piece)
                f, y = features(t), classes.of(t)
                low = 0
                while low < len(y):
                    rows, own, goal = choices(f[:, low : low + size], y[low : low + size])
                    slope = _softmax(w, bias, rows, own)
                    slope[goal, np.arange(len(goal))] -= 1
                    at = rows.ravel()
                    touched[at] = True
                    for k in range(_SIDE):
                        g = np.bincount(at, np.tile(slope[k], 3), _ROWS).astype(np.float32)
                        total[k] += g * g
                        g /= np.sqrt(total[k])
                        g *= _RATE
                        w[:, k] -= g
                    low += size
                    size = min(_LONG_CHUNK, size * 5 // 4)
        if not touched.any():
            return
        change = np.concatenate([w - weights, touched[:, None]], 1).astype(np.float16)
        step = _ROWS // BLOCKS
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array([change[i * step : (i + 1) * step].tobytes() for i in range(BLOCKS)], pa.binary())], ["part", "change"])

    return run


def _mean_change(batches):
    """The mean change of each block, over the partitions that touched a row."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, change in zip(batch.column("part").to_pylist(), batch.column("change").to_pylist()):
            change = np.frombuffer(change, np.float16).reshape(-1, _SIDE + 1).astype(np.float32)
            total[part] = total[part] + change if part in total else change
    mean = [(x[:, :_SIDE] / np.maximum(x[:, _SIDE:], 1)).astype(np.float32).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(mean, pa.binary())], ["part", "change"])


@dataclass
class Model:
    """counts: (token, ending, c) of all training tokens, not in head; head: the most frequent, sorted by hash."""

    counts: DataFrame
    n: int
    v: int
    head: np.ndarray
    head_log: np.ndarray
    classes: Classes
    class_log: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def train(texts: DataFrame, rounds: int = ROUNDS) -> Model:
    """Counts over all texts (text; null: empty) and class weights from all of them. Eager."""
    B.bounded_batches(texts.sparkSession)
    found = texts.select("text").mapInArrow(_counts, "token bigint, ending bigint, c bigint").groupBy("token", "ending").agg(F.sum("c").alias("c"))
    # counts on a logarithmic scale: a few thousand levels at most, from which the head's least count follows
    found = settle(found.withColumn("level", F.floor(F.log2("c") * 64).cast("int")))
    levels = found.groupBy("level").agg(F.count("*").alias("tokens")).collect()
    least, room = 1 << 30, HEAD_TOKENS
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["tokens"]
        if room < 0:
            break
        least = r["level"]
    by_ending = {r["ending"]: (r["n"], r["v"]) for r in found.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n, v = sum(x[0] for x in by_ending.values()), sum(x[1] for x in by_ending.values())
    top = found.where(F.col("level") >= least).select("token", "ending", "c").toArrow()  # HEAD_TOKENS rows at most
    token, ending, c = (top.column(i).to_numpy() for i in range(3))
    by = np.argsort(token.view(np.uint64))
    token, ending, c = token.view(np.uint64)[by], ending[by], c[by]

    common = np.array([i for i in np.lexsort((token, -c)) if ending[i] >= 0][:_SINGLES], np.int64)
    common = common[np.argsort(token[common])] if len(common) else common
    classes = Classes(token[common], np.arange(len(common)))
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for e, (tokens_, distinct) in by_ending.items():
        k = _END_CLASS if e < 0 else _SINGLES + 1 + e
        mass[k] += tokens_
        kinds[k] += distinct
    for place, i in enumerate(common):
        mass[place], kinds[place] = c[i], 1
        mass[_SINGLES + 1 + ending[i]] -= c[i]
        kinds[_SINGLES + 1 + ending[i]] -= 1
    share = (mass + 1).reshape(_SIDE, _SIDE)
    bias = np.log(np.concatenate([share.sum(1)[None, :] / share.sum(), share / share.sum(1, keepdims=True)])).astype(np.float32)

    weights = np.zeros((_ROWS, _SIDE), np.float32)
    if n:
        for _ in range(rounds):
            change = texts.select("text").mapInArrow(_descend(classes, weights, bias), "part bigint, change binary").repartition("part").mapInArrow(_mean_change, "part bigint, change binary")
            # BLOCKS rows, the table as a whole
            weights = weights + np.concatenate([np.frombuffer(r["change"], np.float32).reshape(-1, _SIDE) for r in sorted(change.collect(), key=lambda r: r["part"])])
    return Model(found.where(F.col("level") < least).select("token", "c"), n, v, token, np.log10(c + 1.0), classes, np.log10(mass + kinds + 1), weights, bias)


def _score(model: Model):
    """Rows of each text: one with what is known without a join, and one for each distinct token outside the head."""
    head, head_log, classes, class_log, weights, bias = model.head, model.head_log, model.classes, model.class_log, model.weights, model.bias

    def run(batches):
        for batch in batches:
            for piece in B.slices(batch.column("text")):
                t = tokens(piece)
                n, size = piece.n, np.diff(t.first)
                owner = np.repeat(np.arange(n), size)
                f, y = features(t), classes.of(t)
                logp = np.empty(len(y))
                for low in range(0, len(y), _LONG_CHUNK):
                    logp[low : low + _LONG_CHUNK] = log_classes(weights, bias, f[:, low : low + _LONG_CHUNK], y[low : low + _LONG_CHUNK])
                model_log = np.bincount(owner, logp / np.log(10) - class_log[y], n)
                unique, inverse = np.unique(t.hash, return_inverse=True)
                if len(head):
                    at = np.minimum(np.searchsorted(head, unique), len(head) - 1)
                    hit = head[at] == unique
                    value = np.where(hit, head_log[at], 0.0)
                else:
                    hit, value = np.zeros(len(unique), bool), np.zeros(len(unique))
                count_log, known = np.bincount(owner, value[inverse], n), np.bincount(owner, hit[inverse], n).astype(np.int64)
                rest = np.flatnonzero(~hit[inverse])
                pair, times = np.unique(owner[rest] * len(unique) + inverse[rest], return_counts=True)
                doc = np.concatenate([np.arange(n), pair // max(len(unique), 1)])
                many = len(pair)
                key = batch.column("k").slice(piece.first, n)
                rows = pa.array(doc)
                # the first row of a text is spread by its own hash; kind 0 meets no count
                token = np.concatenate([key.to_numpy(zero_copy_only=False).astype(np.int64), B.signed(unique[pair % max(len(unique), 1)])])
                pad = lambda x: pa.array(np.concatenate([x, np.zeros(many, x.dtype)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(piece.first, n).take(rows), key.take(rows), pad(np.ones(n, np.int64)), pad(size), pad(known), pad(count_log), pad(model_log), pa.array(token), pa.array(np.concatenate([np.zeros(n, np.int64), times]))],
                    ["doc_id", "k", "texts", "n_tokens", "n_known", "count_log", "model_log", "token", "times"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end; a null text is empty, so it has
    the end only. base_score: counts with one added; score: the model's. A repeated row (the same id and text)
    is one document.
    """
    B.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text", "doc_id").alias("k"), "text").mapInArrow(
        _score(model), "doc_id bigint, k bigint, texts bigint, n_tokens bigint, n_known bigint, count_log double, model_log double, token bigint, times bigint"
    )
    counts = model.counts.select("token", F.lit(1).cast("bigint").alias("kind"), "c")
    joined = rows.withColumn("kind", (F.col("times") > 0).cast("bigint")).join(counts, ["token", "kind"], "left")
    sums = joined.groupBy("doc_id", "k").agg(
        F.sum("texts").alias("texts"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("count_log") + F.sum(F.when(F.col("c").isNotNull(), F.col("times") * F.log10(F.col("c") + 1)).otherwise(0.0))).alias("count_log"),
        F.sum("model_log").alias("model_log"),
    )
    each = lambda c: F.expr(f"{c} div texts")
    share = F.col("count_log") / F.col("texts")
    return sums.select(
        "doc_id",
        each("n_tokens").alias("n_tokens"),
        each("n_known").alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (share - each("n_tokens") * float(np.log10(model.n + model.v + 1))).alias("base_score"),
        (share + F.col("model_log") / F.col("texts")).alias("score"),
    )


def lm_report(docs: DataFrame) -> DataFrame:
    """score() of all docs by a model of those that are not held out, with held_out after doc_id."""
    out = held_out(mod=7, remainder=2)
    scored = score(docs, train(docs.where(~out).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
