"""SQL for the queries that SQL can express, written from their contracts and not from the operators' plans."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def mix_sql(weights: dict[str, int], other: int, block_rows: int) -> str:
    """Slot by slot: of the released blocks, the one that is due first; a new phase when a source runs out."""
    names = sorted(weights)
    listed = ", ".join(f"('{name}', {i}, {weights[name]})" for i, name in enumerate(names))
    return f"""
WITH RECURSIVE listed(source, s, w) AS (VALUES {listed}), ranked AS (
  SELECT d.*, coalesce(l.s, {len(names)}) AS s, coalesce(l.w, {other}) AS w,
         row_number() OVER (PARTITION BY coalesce(l.s, {len(names)}) ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), doc_id) - 1 AS r
  FROM documents d LEFT JOIN listed l USING (source)
), supply AS (
  SELECT s, any_value(w) AS w, (count(*) + {block_rows - 1}) // {block_rows} AS n FROM ranked GROUP BY s
), one AS (
  SELECT list(s ORDER BY s) AS ids, list(CAST(w AS BIGINT) ORDER BY s) AS w, list(CAST(n AS BIGINT) ORDER BY s) AS n, range(1, count(*) + 1) AS ix FROM supply
), deal AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS phase, 0::BIGINT AS t, true AS turn, list_transform(ix, lambda i: 0::BIGINT) AS k, list_transform(ix, lambda i: 0::BIGINT) AS issued, 0::BIGINT AS pick FROM one
  UNION ALL
  SELECT slot, phase, t, list_extract(issued, pick) = list_extract(n, pick), k, issued, pick FROM (
    SELECT slot, phase, t + 1 AS t, pick, n, list_transform(ix, lambda i: list_extract(k, i) + CASE WHEN i = pick THEN 1 ELSE 0 END) AS k,
           list_transform(ix, lambda i: list_extract(issued, i) + CASE WHEN i = pick THEN 1 ELSE 0 END) AS issued
    FROM (
      SELECT *, list_min(list_transform(list_filter(ix, lambda i: list_extract(share, i) > 0 AND (list_extract(k, i) * total) // nullif(list_extract(share, i), 0) <= t),
                lambda i: (((list_extract(k, i) + 1) * total + list_extract(share, i) - 1) // nullif(list_extract(share, i), 0)) * 1000 + i)) % 1000 AS pick
      FROM (
        SELECT *, CAST(list_sum(share) AS BIGINT) AS total FROM (
          SELECT slot + 1 AS slot, phase + CASE WHEN turn THEN 1 ELSE 0 END AS phase, CASE WHEN turn THEN 0 ELSE t END AS t, issued, n, ix,
                 CASE WHEN turn THEN list_transform(ix, lambda i: 0::BIGINT) ELSE k END AS k,
                 list_transform(ix, lambda i: CASE WHEN list_extract(issued, i) < list_extract(n, i) THEN list_extract(w, i) ELSE 0 END) AS share
          FROM deal, one
        )
      ) WHERE total > 0
    )
  )
), slots AS (
  SELECT slot, phase, list_extract(ids, pick) AS s, list_extract(issued, pick) - 1 AS block FROM deal, one WHERE slot >= 0
)
SELECT r.doc_id, r.text, r.lang, r.source, r.n_chars, phase, block, slot, slot * {block_rows} + r.r % {block_rows} AS position
FROM ranked r JOIN slots ON r.s = slots.s AND r.r // {block_rows} = slots.block
"""


DECONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bj AS (
  SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS j FROM b WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(ws, j, j + m - 1), ' ') AS w FROM bj
), dj AS (
  SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS j FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m
), hit AS (
  SELECT doc_id, j, dj.m AS m, item_id FROM dj JOIN bw ON dj.m = bw.m AND array_to_string(list_slice(ws, j, j + dj.m - 1), ' ') = w
), inside AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + m)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(inside.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(inside.n, 0) > 0 AS contaminated
FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_DEDUP_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), j AS (
  SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 3 THEN range(1, len(ws) - 1) WHEN len(ws) > 0 THEN [1::BIGINT] ELSE [] END) AS i FROM d
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g FROM j
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON other = x
), component AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN component USING (doc_id)
"""
