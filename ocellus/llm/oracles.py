"""DuckDB SQL for the corpus queries that no model and no tokenizer takes part in."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (SELECT doc_id, p, md5_number(array_to_string(w[p:p + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
covered AS (SELECT words.*, count(later.p) OVER (PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words LEFT JOIN later USING (doc_id, p))
SELECT doc_id, len(d.w) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count_if(gone) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id) USING (doc_id)
"""

SUFFIX_ARRAY_DEDUP = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT doc_id, n, base, substring(x, 2 * base + 1, 1198) AS part FROM (SELECT *, unnest(range(0, n, 500)) AS base FROM d)),
bytes AS (SELECT doc_id, n, base + o AS p, substring(part, 2 * o + 1, 2) AS byte, CASE WHEN base + o + 100 <= n THEN md5_number(substring(part, 2 * o + 1, 200)) END AS h
  FROM (SELECT *, unnest(range(least(500, n - base))) AS o FROM parts)),
ranked AS (SELECT doc_id, p, byte, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS again FROM bytes),
covered AS (SELECT doc_id, p, byte, count_if(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 0 AS gone FROM ranked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM covered)
SELECT doc_id, d.n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count_if(gone) AS removed, count_if(first) AS spans, string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM edges GROUP BY doc_id) USING (doc_id)
"""

BENCHMARK_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
found AS (SELECT doc_id, p, n, item FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[p:p + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id != y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""
