"""DuckDB SQL of the operators that SQL can express exactly."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4
      THEN list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g
  FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM s JOIN reach r ON r.a = s.doc_id
GROUP BY s.doc_id, s.g
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
lens AS (SELECT DISTINCT m FROM win),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT doc_id, i, m, item_id FROM dw JOIN win USING (m, win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


# crc32 of each distinct word by its table of 256 remainders, then the operator's integer arithmetic.
RESAMPLE = rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all({_LOWER}, '{_WORDS}') FROM benchmark),
flat AS (SELECT side, id, unnest(w) AS word FROM words),
polynomial AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) AS c
    FROM range(0, 256) AS r(i))),
bytes AS (
  SELECT word, [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, len(h) // 2)] AS b
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM flat))),
buckets AS (
  SELECT word, xor(4294967295, list_reduce(b, lambda c, x: xor(t[1 + xor(c % 256, x)], c // 256), 4294967295)) % 10000 AS bucket
  FROM bytes, polynomial),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t
  FROM flat JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(ss AS DOUBLE) + 10000)
                                      / ((CAST(s AS DOUBLE) + 1) * (CAST(tt AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM counts, totals),
weights AS (
  SELECT id AS doc_id, CAST(count(*) AS BIGINT) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM flat JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT d.id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                         / 4294967296))) AS BIGINT) AS score
  FROM words d LEFT JOIN weights w ON w.doc_id = d.id WHERE side = 'd'),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranks USING (doc_id)
"""


def build() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN, "op7_decontaminate": DECONTAMINATE, "op12_resample": RESAMPLE}
