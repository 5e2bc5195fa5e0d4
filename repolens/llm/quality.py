"""Quality rules and cross-document line frequency, in DataFrame and SQL functions only.

Rules about a single text are expressions on its row. Lines that very many documents of one host (the source)
have in common are boilerplate: lines are normalised and hashed, documents are counted per host and line,
lines above the limit are removed, and a document that this leaves with too little is rejected. Counts are
pre-aggregated before each shuffle; only (document, line) hashes move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: A line is boilerplate in more documents of a host than this, and than this share of them.
LINE_DOCS = 20
LINE_SHARE = 0.01
#: A document is depleted with fewer words left than this, or less than this share of them.
LEFT_WORDS = 50
LEFT_SHARE = 0.5

# The white space that parts words, as characters and as a pattern; symbols.
_SPACE = "\t\n\x0b\x0c\r "
_GAP = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text, in order; none if it is null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP))


def window_pairs(hashes: Column) -> Column:
    """(h, i) of every 3-word window, sorted; empty if no two windows are equal."""
    distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(distinct, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs)


def repeated_starts(pairs: str) -> Column:
    """First words, ascending, of the windows whose hash has an equal neighbour in the sorted pairs (a column's name)."""
    beside = lambda p, i: F.coalesce(F.get(pairs, i)["h"] == p["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(pairs, lambda p, i: beside(p, i - 1) | beside(p, i + 1)), lambda p: p["i"]))


def _covered(starts: Column) -> Column:
    """Size of the union of [p, p + 3) over ascending p."""
    state = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(starts, state, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])


def normalised(line: Column) -> Column:
    """A line as it is compared: lower-cased, digits alike, white space single and trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), _GAP, " "), F.lit(" "))


def quality(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_left), a row for each row.

    docs needs doc_id, text and source; other columns are ignored. A null text has no words; rows with null
    source are one host. base_failed: under 50 words, or more than half of them in repeated 3-word windows.
    n_left: words outside lines that more than max(line_docs, line_share of the host's) documents share. kept:
    not base_failed and not depleted. Eager: it writes the line hashes once. Rows with equal id, text and source are one document in the counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    host = F.coalesce(F.col("source"), F.lit("\x00"))
    keyed = docs.select("doc_id", text.alias("text"), host.alias("host"), F.xxhash64("doc_id", "text", "source").alias("k"))

    base = keyed.select(
        "doc_id",
        "k",
        words(F.col("text")).alias("w"),
        F.length(F.regexp_replace("text", f"[^{_SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("lines"),
    )
    windows = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    )
    base = base.select("doc_id", "k", F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"), "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), windows.alias("h"))
    rest = ("doc_id", "k", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    base = base.select(*rest, window_pairs(F.col("h")).alias("pairs")).select(*rest, repeated_starts("pairs").alias("starts"))
    base = base.select(*rest, _covered(F.col("starts")).cast("bigint").alias("n_repeat_words"))

    removed = _removed_words(keyed, line_docs, line_share)
    out = base.join(removed, "k", "left").withColumn("n_left", F.col("n_words") - F.coalesce("n_removed", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_left") < LEFT_WORDS) | (F.col("n_left") < F.lit(LEFT_SHARE) * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_left")


def _removed_words(keyed: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """(k, n_removed): words of each document in lines over the limit; documents without such lines are absent."""
    exploded = keyed.select("k", "host", F.explode(F.split("text", "\n", -1)).alias("line")).select("k", "host", normalised(F.col("line")).alias("line")).where("line != ''")
    lines = (
        exploded.select("k", "host", F.xxhash64("host", "line").alias("h"), F.size(F.split("line", " ")).alias("n"))
        .groupBy("k", "host", "h")
        .agg(F.sum("n").alias("n"))
    )
    lines = settle(lines)  # read twice: to count documents, and to find the lines that go
    hosts = keyed.groupBy("host").agg(F.countDistinct("k").alias("docs"))
    often = lines.groupBy("h", "host").agg(F.count("*").alias("docs_with")).where(F.col("docs_with") > line_docs)
    often = often.join(hosts, "host").where(F.col("docs_with") > line_share * F.col("docs")).select("h")
    return lines.join(often, "h").groupBy("k").agg(F.sum("n").alias("n_removed"))


QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT doc_id, t, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), word AS (
  SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w
), gram AS (
  SELECT doc_id, i, x || ' ' || lead(x) OVER p || ' ' || lead(x, 2) OVER p AS g FROM word WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, g FROM gram WHERE g IS NOT NULL GROUP BY doc_id, g HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM gram JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id
), line AS (
  SELECT doc_id, host, trim(regexp_replace(regexp_replace(lower(unnest(lines)), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l
  FROM w
), often AS (
  SELECT host, l FROM line JOIN (SELECT host, count(*) AS docs FROM d GROUP BY host) USING (host)
  GROUP BY host, l, docs HAVING count(DISTINCT doc_id) > {LINE_DOCS} AND count(DISTINCT doc_id) > {LINE_SHARE} * docs
), gone AS (
  SELECT doc_id, sum(length(l) - length(replace(l, ' ', '')) + 1) AS n FROM line SEMI JOIN often USING (host, l) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(ws) - coalesce(gone.n, 0) AS n_left
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_left >= {LEFT_WORDS} AND n_left >= {LEFT_SHARE} * n_words AS kept, CAST(n_left AS BIGINT) AS n_left
FROM b
"""
