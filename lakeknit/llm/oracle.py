"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .queries import LISTED, RULES


def op1_sql(window: int = 35) -> str:
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, i, hash(array_to_string(ws[i:i + {window - 1}], ' ')) AS h
  FROM w, range(1, greatest(1, len(ws) - {window - 2})) AS r(i) WHERE len(ws) >= {window}
), c AS (
  SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)
), g AS (
  SELECT doc_id, list(i ORDER BY i) AS starts FROM c GROUP BY doc_id
), covered AS (
  SELECT doc_id, list(DISTINCT s.i + k) AS gone FROM c AS s, range(0, {window}) AS o(k) GROUP BY doc_id
), out AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM out"""


def op2_sql() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in longest]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, longest, strict=True))
    ruled = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, longest, strict=True))
    entries = ", ".join("{'h': '%s', 'p': '/%s'}" % tuple(u.split("/", 1)) for u in LISTED)
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {ruled} END AS ruled,
    len(list_filter([{entries}], lambda e: (own = e.h OR ends_with(own, '.' || e.h)) AND starts_with(way, e.p))) > 0 AS site
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^(?s:.*)@', ''), ':[0-9]*$', ''), '[.]+$', '') AS own, regexp_replace('/' || path, '/+', '/', 'g') AS way FROM u) AS c
)
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN site THEN 'block' ELSE 'allow' END AS verdict, (ruled IS NULL AND site) AS listed FROM r"""


def op10_sql(window: int = 13) -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH b AS (
  SELECT item_id, {words} AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, ws[i:i + {window - 1}] AS win FROM b, range(1, greatest(2, len(ws) - {window - 2})) AS r(i) WHERE len(ws) > 0
), d AS (
  SELECT doc_id, {words} AS ws FROM documents
), s AS (
  SELECT DISTINCT len(win) AS n FROM bw
), dw AS (
  SELECT doc_id, i, n, ws[i:i + n - 1] AS win FROM d, s, range(1, greatest(1, len(ws) - n + 2)) AS r(i) WHERE len(ws) >= n
), hit AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw ON dw.win = bw.win
), words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, n) AS o(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL whose results equal the queries' on whole tables; the others are tested against brute force."""
    return {"op1_substring_dedup": op1_sql(), "op2_url_filters": op2_sql(), "op10_decontamination": op10_sql()}
