"""DuckDB SQL for the queries that SQL can express; written from the contracts, not from the operators."""

from .licenses import PHRASES, TEMPLATES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_PHRASES = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"({i}, '{label}', string_split('{words}', ' '))" for i, (label, words) in enumerate(TEMPLATES))

ORACLE = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""",
    "op1_warc_normaliser": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
""",
    "op3_license_scan": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
phrases(phrase, n, label) AS (VALUES {_PHRASES}),
base AS (
  SELECT doc_id, i - 1 AS i, label
  FROM d, phrases, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)
  WHERE len(w) >= n AND array_to_string(w[i:i + n - 1], ' ') = phrase
),
base_rows AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         list_sort(list(DISTINCT label)) AS ls FROM base GROUP BY doc_id
),
templates(tid, label, w) AS (VALUES {_TEMPLATES}),
template_grams AS (
  SELECT tid, label, len(w) AS n, i AS t, array_to_string(w[i:i + 2], ' ') AS g
  FROM templates, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i)
),
doc_grams AS (
  SELECT doc_id, i AS p, array_to_string(w[i:i + 2], ' ') AS g
  FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i) WHERE len(w) >= 3
),
hits AS (SELECT doc_id, tid, label, n, t, p, p - t AS diagonal FROM doc_grams JOIN template_grams USING (g)),
diagonals AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER along > 2 THEN 1 ELSE 0 END AS start
  FROM (SELECT DISTINCT doc_id, tid, diagonal FROM hits) WINDOW along AS (PARTITION BY doc_id, tid ORDER BY diagonal)
),
numbered AS (SELECT *, sum(start) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM diagonals),
covered AS (
  SELECT DISTINCT doc_id, tid, label, n, span, t + k AS pos
  FROM hits JOIN numbered USING (doc_id, tid, diagonal), (VALUES (0), (1), (2)) AS v(k)
),
scored AS (SELECT doc_id, tid, label, span, n, count(*) AS words, count(*) / n AS score FROM covered GROUP BY doc_id, tid, label, span, n),
extents AS (SELECT doc_id, tid, span, min(p) AS first_at, max(p) + 2 AS last_at FROM hits JOIN numbered USING (doc_id, tid, diagonal) GROUP BY doc_id, tid, span),
blocks AS (
  SELECT *, CASE WHEN first_at - max(last_at) OVER before > n THEN 1 ELSE 0 END AS start
  FROM scored JOIN extents USING (doc_id, tid, span) WHERE words >= 10
  WINDOW before AS (PARTITION BY doc_id, tid ORDER BY first_at, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
chains AS (SELECT doc_id, tid, span, sum(start) OVER (PARTITION BY doc_id, tid ORDER BY first_at, span) AS chain FROM blocks),
chained AS (SELECT doc_id, tid, label, count(DISTINCT pos) / n AS score FROM covered JOIN chains USING (doc_id, tid, span) GROUP BY doc_id, tid, label, chain, n),
best AS (
  SELECT doc_id, max(score) AS score, coalesce(list(DISTINCT label) FILTER (WHERE score >= 0.8), []) AS ls
  FROM (SELECT doc_id, label, score FROM scored UNION ALL SELECT doc_id, label, score FROM chained) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b.ls, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(s.ls, [])))), ',') AS labels,
       greatest(coalesce(s.score, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base_rows b USING (doc_id) LEFT JOIN best s USING (doc_id)
""",
    "op4_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM sized, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, lengths, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n
),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, s)),
spots AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op7_line_dedup": """
WITH lines AS (
  SELECT doc_id, i, string_split(t, chr(10))[i] AS line
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents),
       LATERAL (SELECT unnest(generate_series(1, len(string_split(t, chr(10))))) AS i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT *, k IN (SELECT k FROM frequent) AS hit FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_minhash_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
  FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - least(4, len(w)) + 1)) AS i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT u, v FROM shared JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)
),
reach AS (SELECT doc_id AS u, doc_id AS r FROM d UNION SELECT l.u, reach.r FROM reach JOIN links l ON l.v = reach.u),
least_of AS (SELECT u AS doc_id, min(r) AS component_id FROM reach GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_of LEFT JOIN n USING (doc_id)
""",
}
