"""DuckDB SQL for the corpus queries that SQL can express whole."""

from __future__ import annotations

from .licenses import TEMPLATES, bigrams, normal

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

#: Sets of shingles, links by Jaccard, and the smallest document reachable.
NGRAM_JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORDS}) AS w FROM documents
), placed AS (
  SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM words
), runs AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM placed
), sets AS (
  SELECT DISTINCT doc_id, s FROM runs WHERE i <= greatest(n - 4, 1)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * p.same >= 75 * (m.n + n.n - p.same)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""

_KNOWN = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{x}'" for x in bigrams(normal(text)))) for name, text in sorted(TEMPLATES.items()))
#: Every unit against every template, without bounds.
LICENSES = rf"""
WITH known(license, grams) AS (VALUES {_KNOWN}),
lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), units AS (
  SELECT doc_id, -1 AS line, text AS unit FROM documents WHERE contains(text, chr(10))
  UNION ALL
  SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS line, unnest(l) AS unit FROM lines
), words AS (
  SELECT doc_id, line, regexp_extract_all(lower(unit), '[a-z0-9]+(?:\.+[a-z0-9]+)*') AS w FROM units
), grams AS (
  SELECT doc_id, line, list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) AS g FROM words WHERE len(w) > 1
), scored AS (
  SELECT doc_id, line, license, 2::DOUBLE * len(list_intersect(g, known.grams)) / (len(g) + len(known.grams)) AS dice FROM grams, known
)
SELECT doc_id, line, license, dice FROM scored WHERE dice >= 0.8 - 1e-12
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1
"""

#: Windows as whole strings, counted; words under a repeated one go.
SUBSTRING_DEDUP = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), placed AS (
  SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM words
), runs AS (
  SELECT doc_id, n, i, word, CASE WHEN i <= n - 34 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS s FROM placed
), again AS (
  SELECT s FROM runs WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1
), marked AS (
  SELECT doc_id, i, word, max(CASE WHEN again.s IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM runs LEFT JOIN again ON again.s = runs.s
), kept AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
