"""The training-data operators against brute force on small fixtures, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repolens.llm import bytesops as B
from repolens.llm import chat, chunks, decontaminate, langid, licenses, lm, mixing, neardup, quality, substrings

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SYLLABLES = "an er th in on ti re ha es ou ing ed nd st le of".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join("zz" + str(r.randint(0, 999)) if r.random() < share else w for w in text.split(" "))


BASE = prose(1, 220)
LONG = prose(2, 9000)
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "One two",
    BASE,
    BASE,
    BASE.upper(),
    edited(BASE, 1, 0.01),
    edited(BASE, 2, 0.02),
    edited(BASE, 3, 0.04),
    edited(BASE, 4, 0.05),
    prose(3, 40) + "\n" + BASE[200:900] + "\n" + prose(4, 40),
    prose(5, 30) + " " + BASE[100:700] + " " + prose(6, 10),
    LONG,
    LONG[:30_000] + " x " + LONG[30_000:],
    "ab" * 700,
    "é" * 500 + " ß " + "é" * 450,
    "same line\nsame line\nother\nsame line\n",
    "x",
    "x",
    "### $$$ %%% ||| 12 34",
    prose(7, 8),
    prose(7, 8) + " more",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, "null id text " + prose(8, 30), "en", "src0", 5))
    # columns with names that operators use themselves
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.withColumns({"k": F.lit(1), "h": F.lit("x"), "slot": F.lit(2), "lang_pred": F.lit("q"), "starts": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_row(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# --- kernel


def test_words_and_slices_equal_regular_expressions():
    texts = [t for t in TEXTS]
    for member, pattern in ((B.WORD_BY_SPACE, SPACE_WORDS), (B.WORD_BY_ALNUM, ALNUM_WORDS)):
        got = []
        for piece in B.slices(pa.array(texts, pa.string()), most=3000):
            low = B.LOWER[piece.data]
            w = B.words(piece, member)
            for d in range(piece.n):
                got.append([low[w.start[i] : w.end[i]].tobytes().decode() for i in range(w.first[d], w.first[d + 1])])
        assert got == [pattern.findall((t or "").translate(LOWER)) for t in texts]


def test_equal_words_hash_alike_in_any_place():
    piece = next(B.slices(pa.array(["Alpha beta", "xx beta ALPHA " + "q" * 300 + " " + "q" * 300])))
    h = B.words(piece, B.WORD_BY_SPACE).hash
    assert h[0] == h[4] and h[1] == h[3] and h[5] == h[6] and len(set(h.tolist())) == 4


# --- 6: near-duplicates


def shingles(text, k):
    w = SPACE_WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def expected_components(rows, k, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[x + 1 :]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(docs, k, percent):
    second_text = docs.where("doc_id = 9").limit(1).withColumn("doc_id", F.lit(3).cast("bigint"))
    docs = docs.unionByName(second_text)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = expected_components(rows, k, percent)
    got = neardup.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_finds_links_that_stars_miss(spark):
    """A chain of texts, each near the next only, in one pool of texts that share most shingles."""
    texts, words = [], prose(20, 120).split(" ")
    for step in range(40):
        words = words[:]
        words[(step * 7) % len(words)] = f"new{step}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = expected_components(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame, 3, 85).collect()} == want


def test_common_counts():
    r = np.random.default_rng(3)
    left = [np.unique(r.integers(0, 400, n).astype(np.uint64)) for n in (0, 1, 30, 200)]
    right = [np.unique(r.integers(0, 400, n).astype(np.uint64)) for n in (5, 0, 300)]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert neardup.common_counts(left, right, columns=32).tolist() == want


def test_densified_signatures_estimate_jaccard():
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 63, 1100).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[100:])
    for cut in (1000, 20):
        x, y = a[:cut], np.unique(np.concatenate([a[: cut - cut // 10], b[-(cut // 10) :]]))
        sig = neardup.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 512)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.15


def test_chains_of_texts_meet_in_their_buckets(spark):
    """Sliding windows over one long text: a cluster of many small buckets, some neighbours near enough to link."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(9000)]
    at, rows = 0, []
    for i in range(300):
        rows.append((r.randrange(10**9), " ".join(words[at : at + 100])))
        at += r.choice([3, 5, 8, 17, 25])
    shingles = {d: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[i + 1 : i + 40]:
            if 100 * len(shingles[a] & shingles[b]) >= 85 * len(shingles[a] | shingles[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(frame, 3, 85).collect()}
    assert got == {d: find(d) for d, _ in rows} and 20 < len(set(got.values())) < 280


def test_without_near_duplicates_keeps_one_of_each(docs):
    kept = neardup.without_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").where("doc_id IS NOT NULL").collect())
    want = expected_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 3, 85)
    assert ids == sorted(i for i, c in want.items() if i == c)


def test_near_dedup_id_with_several_texts_joins_their_classes(spark):
    """9 is the smallest id of neither class; 12 joins two texts that are too short for bands."""
    a, b = prose(60, 50), prose(61, 50)
    rows = [(3, b), (5, a), (9, a), (9, b), (10, "one two"), (11, "three four"), (12, "one two"), (12, "three four"), (20, prose(62, 50))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(3, 3), (5, 3), (9, 3), (10, 10), (11, 10), (12, 10), (20, 20)}


# --- 5: exact substrings


def covered_bytes(texts, least):
    raw = [(t or "").encode() for t in texts]
    times = collections.Counter(b[p : p + least] for b in raw for p in range(len(b) - least + 1))
    out = []
    for b in raw:
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - least + 1):
            if times[b[p : p + least]] > 1:
                mark[p] += 1
                mark[p + least] -= 1
        out.append(np.cumsum(mark)[:-1] > 0)
    return raw, out


def test_substring_report_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    raw, gone = covered_bytes([r["text"] for r in rows], 400)
    want = []
    for r, b, g in zip(rows, raw, gone):
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        want.append((r["doc_id"], len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert by_row(substrings.substring_report(docs)) == sorted(want, key=repr)
    assert by_row(substrings.substring_report(docs, words=51).drop("n_repeated")) == sorted(want, key=repr)


def test_substring_report_counts_short_passages(spark):
    """A passage of 51 words under 400 bytes is repeated, but not removed; one of 50 words is neither."""
    item, short = prose(90, 51), prose(91, 50)
    assert len(item) < 400
    rows = [(i, " ".join([prose(810 + i, 70), item, prose(910 + i, 20), short, prose(960 + i, 70)])) for i in range(2)] + [(2, prose(830, 90)), (3, None)]
    got = {r["doc_id"]: (r["n_removed"], r["n_repeated"]) for r in substrings.substring_report(spark.createDataFrame(rows, "doc_id bigint, text string"), words=51).collect()}
    assert got == {0: (0, len(item)), 1: (0, len(item)), 2: (0, 0), 3: (0, 0)}


def test_open_borders_are_common_prefixes():
    r = random.Random(5)
    text = "".join(r.choice("ab") for _ in range(300)) * 2 + "".join(r.choice("abc") for _ in range(200))
    symbols = np.concatenate([np.frombuffer(text.encode(), np.uint8).astype(np.int16) + 1, [0]]).astype(np.int16)
    raw = text + "\x00"
    for least in (1, 3, 20):
        order = substrings.suffix_order(symbols, 64)
        got = substrings.open_borders(symbols, order, least)
        for i in range(1, len(order)):
            a, b = raw[order[i - 1] :], raw[order[i] :]
            assert got[i] == (a[:least] == b[:least] and min(len(a), len(b)) >= least)


def test_repeated_windows_equal_brute_force():
    r = random.Random(11)
    for _ in range(300):
        least, base = r.choice([3, 5, 8, 20]), bytes(r.choices(b"abc"[: r.randint(1, 3)], k=60))
        bodies = set()
        for _ in range(r.randint(1, 8)):
            low = r.randint(0, 30)
            body = bytearray(base[low : low + r.randint(least, least + 25)])
            body[r.randrange(len(body))] = r.choice([0, 97, 98, 255])
            bodies.add(bytes(body))
        bodies = sorted(bodies)
        copies = [r.choice([1, 1, 2, 3]) for _ in bodies]
        starts = [range(len(b) - least + 1) for b in bodies]
        times = collections.Counter()
        for b, c, at in zip(bodies, copies, starts):
            for p in at:
                times[b[p : p + least]] += c
        got = substrings.repeated_windows(bodies, copies, least)
        assert [x.tolist() for x in got] == [[times[b[p : p + least]] > 1 for p in at] for b, at in zip(bodies, starts)]


def test_repeated_windows_sort_little(monkeypatch):
    """Copies are sorted once, and a suffix only until it differs from all others."""
    shared = prose(50, 100)
    bodies = [(prose(51 + i, 60)[-200:] + shared + prose(71 + i, 60)[:200]).encode() for i in range(8)]
    sizes, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: sizes.append(len(x)) or plain(x, *a, **b))
    got = substrings.repeated_windows(bodies, [2] * 8, 400)
    assert all(x.all() for x in got) and sum(sizes) < 8 * sum(len(b) + 1 for b in bodies)


def test_remove_repeats_keeps_rows_and_columns(docs):
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id IS NOT NULL").collect()}
    assert texts[0] is None and texts[3] == "one" and texts[6] == "" and len(texts[12]) < len(TEXTS[12])


def test_remove_passages_equals_brute_force(spark, docs):
    """Planted passages of 51 words go, however short in bytes; one of 50 stays."""
    short = " ".join("abcdefghij"[i % 10] for i in range(60, 111))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    plant = lambda i, p: (i, prose(i, 20) + " " + p + " " + prose(i + 1, 20))
    rows += [plant(9000, prose(40, 51)), plant(9010, prose(40, 51).replace(" ", "\n")), plant(9020, prose(41, 50)), plant(9030, prose(41, 50)), plant(9040, short), plant(9050, short)]
    rows += [plant(9060 + 10 * i, prose(43, 60)[:-i] + "q") for i in range(1, 4)]
    raw, gone = covered_bytes([t for _, t in rows], 400)
    word = re.compile(SPACE_WORDS.pattern.encode())
    windows = [[(m.start(), m.end()) for m in word.finditer(b)] for b in raw]
    grams = [[tuple(b[x:y] for x, y in w[p : p + 51]) for p in range(len(w) - 50)] for b, w in zip(raw, windows)]
    times = collections.Counter(g for gs in grams for g in gs)
    for g, w, gs in zip(gone, windows, grams):
        for p, x in enumerate(gs):
            if times[x] > 1:
                g[w[p][0] : w[p + 50][1]] = True
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substrings.remove_passages(frame, words=51)
    want = [(i, None if t is None else np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore")) for (i, t), b, g in zip(rows, raw, gone)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    left = {r["doc_id"]: r["text"] for r in got.where("doc_id >= 9000").collect()}
    assert prose(40, 51) not in left[9000] and prose(41, 50) in left[9020] and short not in left[9040]


# --- 4: chunks


def test_chunks_are_a_partition_and_resist_shifts():
    data = np.frombuffer(LONG.encode(), np.uint8)
    shifted = np.frombuffer(("inserted " + LONG).encode(), np.uint8)
    parts = []
    for x in (data, shifted):
        ends = chunks.cut(chunks.gear_ends(x).tolist(), 0, len(x))
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(x) and sizes[:-1].min() >= chunks.LEAST and sizes.max() <= chunks.MOST
        parts.append({x[a:b].tobytes() for a, b in zip([0, *ends], ends)})
    assert len(parts[0] & parts[1]) > 0.98 * len(parts[0])


def test_chunk_report_against_a_plain_version(docs):
    rows = sorted({(r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.select("doc_id", "text").collect()})
    key = {(r["d"], r["text"]): r["k"] for r in docs.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("k")).collect()}
    rows_seen = [(r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    times, cuts = collections.Counter(), {}
    for d, t in rows_seen:
        b = t.encode()
        x = np.frombuffer(b, np.uint8)
        ends = chunks.cut(chunks.gear_ends(x).tolist(), 0, len(b)) if b else []
        cuts[d, t] = [(a, e, b[a:e]) for a, e in zip([0, *ends], ends)]
        times.update(c for _, _, c in cuts[d, t])
    owner = {}
    for d, t in sorted(rows, key=lambda r: (r[0], key[r])):
        for a, _, c in cuts[d, t]:
            owner.setdefault(c, (d, key[d, t], a))
    want = {}
    for d, t in rows:
        removed = repeated = 0
        run = []
        for a, e, c in [*cuts[d, t], (0, 0, None)]:
            if c is not None and times[c] > 1:
                run.append((a, e, c))
                continue
            if sum(e2 - a2 for a2, e2, _ in run) >= chunks.RUN_BYTES:
                repeated += sum(e2 - a2 for a2, e2, _ in run)
                removed += sum(e2 - a2 for a2, e2, c2 in run if owner[c2] != (d, key[d, t], a2))
            run = []
        want[d, len(t.encode())] = (removed, repeated)
    for r in chunks.chunk_report(docs).collect():
        d = r["doc_id"] if r["doc_id"] is not None else -1
        assert (r["n_removed"], r["n_repeated"]) == want[d, r["n_bytes"]]


# --- 3: benchmark decontamination


def test_contamination_equals_brute_force(spark, docs):
    words = BASE.split(" ")
    items = [(1, " ".join(words[20:45])), (2, "A " + words[60].upper() + " b"), (3, ""), (4, None), (None, BASE), (5, "One two"), (6, " ".join(words[100:110])), (7, prose(99, 30)), (8, "one"), (8, words[3])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("fp", F.lit(3))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM_WORDS.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for j in range(len(w) - m + 1) if m and i is not None else ():
            windows[tuple(w[j : j + m])].add(str(i))
    want = set()
    for r in docs.select("doc_id", "text").collect():
        w = ALNUM_WORDS.findall((r["text"] or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if names := windows.get(tuple(w[j : j + m])):
                    found |= names
                    hit[j : j + m] = [True] * m
        want.add((r["doc_id"], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    got = decontaminate.contamination_report(docs, bench)
    assert by_row(got) == sorted(want, key=repr)
    small_ids = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert decontaminate.decontaminated(small_ids, bench).count() == decontaminate.decontaminated(docs, bench).count()
    left = decontaminate.decontaminated(docs, bench)
    bad = {d for d, _, n, *_ in want if n}
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {d for d, *_ in want} - bad


# --- 2: languages


def test_language_held_out_accuracy_and_spans(spark):
    german = "un der die und sch ei zu ber ge lich ung keit".split()
    r = random.Random(6)
    text = lambda syl, n: " ".join("".join(r.choice(syl) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(german if i % 2 else SYLLABLES, 60), "de" if i % 2 else "en") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.language_report(frame).join(frame, "doc_id")
    assert out.where("held_out").count() > 30
    assert out.where("held_out AND lang_pred != lang").count() == 0
    model = langid.train(frame)
    mixed = spark.createDataFrame([(1, text(german, 40) + " " + text(SYLLABLES, 80)), (2, "12 34 !"), (3, None), (4, "—"), (5, "привет мир")], "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in langid.identify(mixed, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[1]["span_langs"] == ["de", "en"] and 0.5 < got[1]["score"] < 0.8
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and got[5]["score"] == 0


def test_language_labels_do_not_depend_on_slices():
    r = np.random.default_rng(13)
    model = langid.Model(["a", "b", "c"], np.log(r.random((langid._TABLE, 3))).astype(np.float32), np.ones((len(langid._NAMES), 3), bool), 0)
    texts = pa.array([prose(i, 5 + i) for i in range(60)])
    both = []
    for most in (200, 1 << 20):
        parts = [langid.label_slice(piece, model) for piece in B.slices(texts, most)]
        both.append([(x, round(float(y), 9)) for labels, share, *_ in parts for x, y in zip(labels, share)])
    assert both[0] == both[1]


def test_viterbi_equals_all_label_sequences():
    import itertools

    r = np.random.default_rng(8)
    lengths = [0, 1, 5, 3, 6]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score = r.normal(size=(first[-1], 3)).astype(np.float32) * 2
    got = langid.viterbi(score, first, 1.5)
    value = lambda s, labels: sum(s[i, x] for i, x in enumerate(labels)) - 1.5 * sum(a != b for a, b in zip(labels, labels[1:]))
    for a, b in zip(first, first[1:]):
        if b > a:
            best = max(value(score[a:b], x) for x in itertools.product(range(3), repeat=int(b - a)))
            assert abs(value(score[a:b], got[a:b]) - best) < 1e-4


def test_language_stage_keeps_columns(docs):
    out = langid.only_identified(docs)
    assert out.columns == docs.columns
    assert not {0, 1, 2} & {r["doc_id"] for r in out.collect()}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.only_identified(unlabelled).count() == docs.count()


# --- 1: mixing


def check_mix(rows, weights, other, block_rows):
    """Blocks in slots without gaps; in each phase every source stays within a block of its share."""
    slots = {}
    for r in rows:
        s = r["source"] if r["source"] in weights else None
        slots.setdefault(r["slot"], (s, r["phase"], r["block"]))
        assert slots[r["slot"]] == (s, r["phase"], r["block"])
    assert sorted(slots) == list(range(len(slots)))
    share = {**weights, None: other}
    phase, begin = None, 0
    for t in range(len(slots)):
        if slots[t][1] != phase:
            phase, begin, dealt = slots[t][1], t, collections.Counter()
            active = {slots[u][0] for u in range(t, len(slots))}
            total = sum(share[s] for s in active)
        dealt[slots[t][0]] += 1
        for s in active:
            assert abs(dealt[s] - (t - begin + 1) * share[s] / total) < 1


def test_mix_keeps_every_row_within_a_block(spark):
    r = random.Random(9)
    rows = [(i, f"text {i}", r.choices(["a", "b", "c", "d", None], [60, 20, 10, 8, 2])[0]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = {"a": 5, "b": 3, "c": 7, "absent": 2}
    got = mixing.mix(frame, weights, other=2, block_rows=8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    assert [r["position"] for r in got] == sorted({r["position"] for r in got})
    check_mix(got, weights, 2, 8)


def test_mix_edge_cases(docs, empty):
    got = mixing.mix(docs, {"src0": 2, "src1": 1})
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns)
    assert mixing.mix(docs, {}).count() == docs.count()
    assert mixing.mix(empty, {"src0": 2}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 0})


# --- 7: quality rules


def test_quality_equals_plain_python(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    got = quality.quality(docs, line_docs=1, line_share=0.0)
    assert got.count() == len(rows)
    line_docs = collections.defaultdict(set)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if norm(x):
                line_docs[r["source"], norm(x)].add((r["doc_id"], r["text"]))
    want = []
    for r in rows:
        text = r["text"] or ""
        w = SPACE_WORDS.findall(text)
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
        gone = sum(len(norm(x).split(" ")) for x in text.split("\n") if norm(x) and len(line_docs[r["source"], norm(x)]) > 1)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        left = len(w) - gone
        symbols = sum(c in "#*$%&|<>" for c in text)
        want.append((r["doc_id"], len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed, not failed and left >= 50 and left >= 0.5 * len(w), left))
    assert by_row(got) == sorted(want, key=repr)


# --- 8: licences


def test_license_scan(spark):
    mit = next(t for n, t in licenses.NOTICES if n == "MIT" and t.startswith("Permission"))
    rows = [
        (1, prose(30, 200) + "\nLicensed under CC BY-NC 4.0.\n" + prose(31, 100)),
        (2, "Copyright\n\n" + mit.replace(" ", "\n", 20).upper()),
        (3, prose(32, 500)),
        (4, None),
        (5, "license"),
        (6, mit.replace("Software", "Program") + " Licensed under the Apache License, Version 2.0."),
        (7, prose(33, 20_000) + " This work is licensed under the GNU General Public License, version 3."),
    ]
    out = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [out[i]["licenses"] for i in range(1, 8)] == ["CC-BY-NC-4.0", "MIT", "", "", "", "Apache-2.0,MIT", "GPL-3.0-only"]
    assert out[1]["dice"] == 1 and 0.8 <= out[6]["dice"] and out[3]["license_id"] is None


def test_whole_licences_are_told_apart(spark):
    """Every whole text is found as itself, with a copyright line and prose around it; shared openings name both."""
    whole = licenses.whole_texts()
    opening = next(t for n, t in licenses.NOTICES if " OR " in n)
    rows = [(i, f"{prose(50 + i, 40)}\nCopyright (c) 2020 Somebody\n{text}\n{prose(80 + i, 40)}") for i, (_, text) in enumerate(whole)] + [(100, opening)]
    out = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, (name, _) in enumerate(whole):
        assert out[i]["license_id"] == name and out[i]["dice"] >= 0.95, (name, out[i])
    assert out[100]["license_id"] == "BSD-2-Clause OR BSD-3-Clause"


def test_license_ties_and_repeats(spark):
    """Equal passages: a licence once; equal templates: the first name; a paragraph 10,000 times: found, in bounded time."""
    mit = next(t for n, t in licenses.NOTICES if n == "MIT" and t.startswith("Permission"))
    typo = mit.replace("free of charge", "without charge")
    rows = [(1, "Licensed under CC BY 4.0. Licensed under CC BY 4.0."), (2, (typo + "\n") * 10_000), (1, "Licensed under CC BY 4.0. Licensed under CC BY 4.0.")]
    out = licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["licenses"]) for r in out) == [(1, "CC-BY-4.0"), (1, "CC-BY-4.0"), (2, "MIT")]
    twice = spark.createDataFrame([(1, "one two three four five")], "doc_id bigint, text string")
    assert licenses.scan(twice, (("B", "one two three four five"), ("A", "one two three four five"))).first()["licenses"] == ["A"]


def test_best_passage_equals_all_passages():
    r = random.Random(11)
    template = licenses.Template("t", np.unique(B.keyed(12, 1)))
    for _ in range(30):
        gram = np.array([r.choice(list(template.bigrams)) if r.random() < 0.6 else r.getrandbits(60) for _ in range(40)], np.uint64)
        at = np.flatnonzero(np.isin(gram, template.bigrams))
        got = licenses.best_passage(gram, at, template, 0.5)[0]
        want = 0.0
        for i in range(40):
            for j in range(i + 1, 41):
                own = set(gram[i:j].tolist())
                d = 2 * len(own & set(template.bigrams.tolist())) / (len(own) + 12)
                want = max(want, d)
        assert abs(got - (want if want >= 0.5 else 0.0)) < 1e-9


# --- 9: language model


def test_lm_counts_equal_brute_force_and_model_beats_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_TOKENS", 100)
    rows = [(i, prose(100 + i % 7, 80) if i % 3 else prose(i, 60)) for i in range(120)] + [(500, None), (501, "new words only here"), (502, LONG)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("token", F.lit("clash"))
    got = {r["doc_id"]: r for r in lm.lm_report(frame).collect()}
    tokens = {i: [*SPACE_WORDS.findall((t or "").translate(LOWER)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for i, ws in tokens.items():
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_probabilities_add_up_to_one(spark):
    """Over all classes, and over the seen and the unknown tokens of each class."""
    rows = [(i, prose(i, 30)) for i in range(40)]
    model = lm.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    f = np.array([[7], [11], [13]])
    every = [np.exp(lm.log_classes(model.weights, model.bias, f, np.array([y])))[0] for y in range(lm.CLASSES)]
    assert abs(sum(every) - 1) < 1e-4
    counts = collections.Counter(w for _, t in rows for w in [*t.split(" "), None])
    assert model.n == sum(counts.values()) and model.v == len(counts)
    # each class: (c + 1) of its tokens and 1 for unknown ones, over mass + kinds + 1
    total = (10**model.class_log - 1).sum()
    assert abs(total - (model.n + model.v)) < 1e-6 * total


def test_lm_weights_learn_from_every_training_text(spark):
    """More texts than the 12,000 that the weights were once fit to: each leaves its features in the table."""
    texts = [f"a{i} b{i}" for i in range(24_000)]
    model = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), rounds=1)
    rows = np.unique(np.concatenate([lm.features(lm.tokens(piece)).ravel() for piece in B.slices(pa.array(texts))]))
    assert (model.weights[rows * (lm._SIDE + 1)] != 0).any(1).all()


def test_lm_score_equals_plain_sums(spark):
    """Each token: the softmax of its group, that of its class in the group, and its share of the class."""
    texts = [prose(i, 25) for i in range(30)] + ["Zebra unknown", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = lm.train(frame.where("doc_id < 30").select("text"))
    counts = collections.Counter(w for t in texts[:30] for w in [*t.translate(LOWER).split(" "), None])
    got = {r["doc_id"]: r["score"] for r in lm.score(frame, model).collect()}
    for i, text in enumerate(texts):
        piece = next(B.slices(pa.array([text], pa.string())))
        t = lm.tokens(piece)
        words = [*(text or "").translate(LOWER).split(), None]
        want = 0.0
        for word, f, y in zip(words, lm.features(t).T, model.classes.of(t)):
            group, inner = divmod(int(y), lm._SIDE)
            for row, goal in ((0, group), (1 + group, inner)):
                z = [model.bias[row][k] + sum(model.weights[int(x) * (lm._SIDE + 1) + row][k] for x in f) for k in range(lm._SIDE)]
                want += math.log10(math.exp(z[goal]) / sum(map(math.exp, z)))
            want += math.log10(counts[word] + 1) - model.class_log[y]
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))


# --- 10: chat


def chats(n: int, turns: int = 8):
    """Conversations as rows: a system turn in every fourth, then users, who are brief, and assistants, who are not."""
    r = random.Random(12)
    rows = [(c, t, ["user", "assistant"][t % 2], prose(1000 * c + t, r.randint(3, 12) if t % 2 == 0 else r.randint(30, 60)) + ("\n" + prose(t, 9) if t % 3 == 1 else "")) for c in range(n) for t in range(r.randint(1, turns))]
    return rows + [(c, -1, "system", "You are told what to do.") for c in range(0, n, 4)]


CHAT = "conv_id bigint, turn bigint, role string, text string"


def by_markers_only(text: str) -> list[str]:
    """Roles of the lines with a marker; an unmarked line goes on with the turn before it."""
    return [chat.ROLES[(s[0] // 2 - 1) // 2] for s in chat.observed(text)[2] if s[0] >= 2]


def test_chat_recovers_marked_and_unmarked_roles(spark):
    """Every style on conversations held out from the fit; markers alone lose the unmarked turns of styles 3 and 4."""
    frame = spark.createDataFrame(chats(300), CHAT)
    frame = frame.unionByName(frame.limit(5)).withColumn("roles", F.lit("clash"))
    laid = chat.transcripts(frame)
    made = chat.format_chat(laid.withColumn("raw", F.col("transcript")), text="raw", model=chat.fit(laid)).where(langid.held_out("conv_id")).withColumn("style", chat.style_of())
    hits, base, n = collections.Counter(), collections.Counter(), collections.Counter()
    for r in made.collect():
        n[r["style"]] += 1
        hits[r["style"]] += r["roles"] == r["truth"]
        base[r["style"]] += by_markers_only(r["transcript"]) == r["truth"]
    assert set(n) == set(range(chat.STYLES))
    assert all(hits[s] >= 0.95 * n[s] for s in n), (hits, n)
    assert all(base[s] <= 0.6 * n[s] for s in (3, 4)), (base, n)
    report = chat.chat_report(frame)
    assert report.count() == 300 and report.where("rendered NOT LIKE '<|im_start|>%'").count() == 0


def test_chat_viterbi_equals_all_state_sequences():
    r = np.random.default_rng(5)
    model = chat.model_of()
    paths = np.array(list(itertools.product(range(chat._STATES), repeat=4)))
    for _ in range(20):
        scores = r.normal(size=(4, chat._STATES)) * 3
        value = model.start[paths[:, 0]] + scores[np.arange(4), paths].sum(1) + model.move[paths[:, :-1], paths[:, 1:]].sum(1)
        assert chat.best_states(scores, model) == paths[value.argmax()].tolist()
        for before, last in ((None, 3), (2, 5), (4, 1)):
            value = (model.start if before is None else model.move[before])[paths[:, 0]] + scores[np.arange(4), paths].sum(1) + model.move[paths[:, :-1], paths[:, 1:]].sum(1)
            value[paths[:, -1] != last] = -np.inf
            assert chat.best_states(scores, model, before, last) == paths[value.argmax()].tolist()
            assert abs(chat.best_scores(scores, model, before is None)[before or 0, last] - value.max()) < 1e-9
    assert chat.best_states(np.zeros((1, chat._STATES)) - model.start, model) == [0]


def test_chat_long_conversation_is_one_sequence(spark, monkeypatch):
    """1,000 turns in parts: the roles are those of the parts decoded as one transcript."""
    rows = [(7, t, ["user", "assistant"][t % 2], prose(t, 5 if t % 2 == 0 else 40)) for t in range(1000)] + [(8, 0, "user", "hi"), (None, 300, "user", "no id"), (None, 5, "user", "no id")]
    frame = spark.createDataFrame(rows, CHAT)
    parts = chat.transcripts(frame)
    model = chat.model_of()
    got = sorted(((r["segment"], r["roles"], r["transcript"]) for r in chat.format_chat(parts.withColumn("raw", F.col("transcript")), text="raw", model=model).where("conv_id = 7").collect()))
    assert len(got) == 4
    whole = [role for role, _ in chat.parse("\n".join(x for _, _, x in got), model)]
    assert [role for _, roles, _ in got for role in roles] == whole
    assert chat.chat_report(frame).count() == 4 + 1 + 2


def test_chat_parse_cases():
    assert chat.parse(None) == [] and chat.parse(" \n ") == []
    turns = chat.parse("User: hi there?\n\nmore of it\nAssistant: yes.\nNote: this is no speaker\n### Human:\nnext")
    assert turns == [("user", "hi there?\n\nmore of it"), ("assistant", "yes.\nNote: this is no speaker"), ("user", "next")]
    assert chat.render([("user", "a")]) == "<|im_start|>user\na<|im_end|>\n"


def test_chat_edge_rows(spark):
    """Null and unknown roles, null and very long texts, ties of turn, repeated rows, null ids."""
    rows = [(1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 1, None, None), (1, 2, "tool", "x"), (2, 0, "user", LONG), (2, 1, "assistant", "b"), (2, 1, "assistant", "c"), (None, None, None, None), (3, None, "user", "q?")]
    out = {r["conv_id"]: r for r in chat.chat_report(spark.createDataFrame(rows, CHAT)).collect()}
    assert set(out) == {1, 2, 3, None} and out[None]["n_turns"] == 0 and out[None]["rendered"] == ""
    assert out[2]["roles"].startswith("user,assistant") and LONG in out[2]["rendered"] and out[3]["roles"] == "user"


# --- empty tables


def test_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    conv = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    for frame in (
        neardup.near_duplicates(empty),
        substrings.substring_report(empty),
        chunks.chunk_report(empty),
        decontaminate.contamination_report(empty, bench),
        langid.language_report(empty),
        quality.quality(empty),
        licenses.license_report(empty),
        lm.lm_report(empty),
        chat.chat_report(conv),
    ):
        assert frame.count() == 0
    assert decontaminate.contamination_report(docs, bench).where("contaminated").count() == 0
