"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str = "text") -> str:
    return f"SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, regexp_extract_all({text}, '{_WORD}') AS ws FROM documents)"


def _windows(size: int) -> str:
    """words, windows (doc_id, k, g) and gone (doc_id, k)."""
    return f"""
words AS ({_words()}),
windows AS (
  SELECT doc_id, k, md5(g) AS g FROM (
    SELECT doc_id, k, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING))
  WHERE n = {size}),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, k + d AS k FROM windows JOIN firsts USING (g), generate_series(0, {size - 1}) t(d)
  WHERE first < doc_id)"""


SUBSTRING_DEDUP = f"""
WITH {_windows(13)},
told AS (
  SELECT doc_id, count(*) AS n_words, count(gone.k) AS n_removed,
         string_agg(word, ' ' ORDER BY k) FILTER (gone.k IS NULL) AS kept
  FROM words LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN told USING (doc_id)
"""

SUFFIX_DEDUP = f"""
WITH {_windows(50)},
islands AS (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM gone)
SELECT doc_id, min(k) - 1 AS start_word, max(k) AS end_word, max(n) AS n_words
FROM islands JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id) USING (doc_id)
GROUP BY doc_id, island
"""

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (first IS NULL OR first >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id
"""

NGRAM_JOIN = f"""
WITH RECURSIVE words AS ({_words(_LOWER.format('text'))}),
runs AS (
  SELECT doc_id, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS total
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
grams AS (SELECT DISTINCT doc_id, md5(g) AS g FROM runs WHERE n = least(3, total)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (max(x.n) + max(y.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
