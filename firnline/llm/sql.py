"""DuckDB SQL for the rows of the operator queries that SQL can express."""

#: Marking by exact windows of ten words: every document window is looked up among the benchmark's windows.
DECONTAMINATION = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)),
windows AS (SELECT win, n, list(DISTINCT item) AS items FROM win GROUP BY win, n),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
spot AS (
  SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows))),
hit AS (SELECT spot.rid, spot.s, spot.n, windows.items FROM spot JOIN windows USING (win, n)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, unnest(items) AS item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
"""

#: Temperature mixing: 95 % of the largest entropy unless a source would be read over twice.
MIXING = r"""
WITH RECURSIVE u AS (
  SELECT coalesce(source, '') AS source, doc_id, md5(coalesce(text, '')) AS content,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) + 1 AS tokens
  FROM documents),
g AS (SELECT *, tokens * copies AS cost FROM (SELECT source, doc_id, content, tokens, count(*) AS copies FROM u GROUP BY ALL)),
t AS (SELECT source, CAST(sum(cost) AS BIGINT) AS total FROM g GROUP BY source),
s AS (SELECT list(total / whole ORDER BY total) AS ps, max(total) AS big, max(total) / min(total) AS ratio, 0.95 * ln(count(*)) AS least
      FROM (SELECT total, sum(total) OVER () AS whole FROM t)),
e(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN high THEN lo ELSE mid END, CASE WHEN high THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
               ln(list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2)))) - (lo + hi) / 2 * list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) < least AS high
        FROM e, s WHERE step < 40)),
r(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN high THEN lo ELSE mid END, CASE WHEN high THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, pow(ratio, 1 - (lo + hi) / 2) <= 2 AS high FROM r, s WHERE step < 40)),
x AS (
  SELECT round(greatest(
    CASE WHEN -list_sum(list_transform(ps, lambda p: p * ln(p))) >= least THEN 1 ELSE (SELECT (lo + hi) / 2 FROM e WHERE step = 40) END,
    CASE WHEN ratio <= 2 THEN 0 ELSE (SELECT (lo + hi) / 2 FROM r WHERE step = 40) END), 6) AS a FROM s),
w AS (
  SELECT source, total, CAST(round(big * pow(total / big, a)) AS BIGINT) AS quota FROM t, s, x),
p AS (
  SELECT source, doc_id, content, tokens, copies, cost, total, quota,
         unnest(range(0, CAST(floor((quota - 1) / total) AS BIGINT) + 1)) AS pass
  FROM g JOIN w USING (source) WHERE quota > 0),
d AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', source, coalesce(CAST(doc_id AS VARCHAR), ''), content, pass)), 1, 15))::BIGINT AS draw FROM p),
o AS (
  SELECT *, coalesce(sum(cost) OVER (PARTITION BY source, pass ORDER BY draw % 1024, draw, doc_id, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM d)
SELECT source, doc_id, tokens AS n_tokens, pass, CAST(begun + j * tokens AS BIGINT) AS start
FROM (SELECT *, unnest(range(0, copies)) AS j FROM o WHERE begun < quota - pass * total)
"""

#: Every 200-byte window of the texts in hexadecimal digits; those found twice cover what is removed.
REPEATED_STRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS h FROM documents),
p AS (SELECT rid, j, substr(h, 1024 * j + 1, 1422) AS piece FROM (SELECT rid, h, unnest(range(0, CAST(length(h) // 1024 + 1 AS BIGINT))) AS j FROM d)),
w AS (SELECT rid, 512 * j + o AS i, md5(substr(piece, 2 * o + 1, 400)) AS k FROM (SELECT rid, j, piece, unnest(range(0, CAST(least(512, length(piece) // 2 - 199) AS BIGINT))) AS o FROM p)),
r AS (SELECT rid, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
s AS (SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 200, TRUE) AS fresh FROM r),
g AS (SELECT rid, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY rid ORDER BY i) AS run FROM s),
spans AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY rid, run),
edges AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
per AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY rid),
parts AS (SELECT rid, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k FROM edges JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(parts.k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per USING (rid) LEFT JOIN parts USING (rid)
"""

#: The trie from whole prefixes as lists; crc32 bit by bit, eight steps for each byte.
PREFIX_TRIE = r"""
WITH own AS (
  SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 32), left(coalesce(text, ''), 32)) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
seq AS (SELECT c, list(x ORDER BY p) AS xs FROM own GROUP BY c),
bits AS (
  SELECT c, xs, list_reduce(
    [CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END FOR i IN range(8 * length(CAST(c AS VARCHAR)))],
    lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END),
    CAST(4294967295 AS BIGINT)) AS crc
  FROM seq),
built AS (
  SELECT b.c, list_concat(coalesce(h.xs[1:(4294967295 - b.crc) % 6], []), b.xs[(4294967295 - b.crc) % 6 + 1:]) AS xs
  FROM bits b LEFT JOIN seq h ON h.c = b.c - b.c % 100),
pre AS (SELECT c, d, len(xs) AS n, to_json(xs[1:d]) AS k, to_json(xs[1:d - 1]) AS up, CASE WHEN d = 0 THEN 0 ELSE length(xs[d].t) END AS pts
        FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM built)),
node AS (SELECT k, any_value(up) AS up, d, any_value(pts) AS pts, min(c) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
         FROM pre GROUP BY k, d),
kids AS (SELECT up, count(*) AS m FROM node WHERE d > 0 GROUP BY up),
line AS (SELECT DISTINCT a.k AS top, b.k AS sub FROM pre a JOIN pre b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT top AS k, sum((n_convs - 1) * pts) AS saved, count(*) FILTER (WHERE kids.up IS NULL) AS leaves
         FROM line JOIN node ON node.k = sub LEFT JOIN kids ON kids.up = sub GROUP BY top)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.m, 0) AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sums s ON s.k = n.k LEFT JOIN kids ON kids.up = n.k LEFT JOIN node p ON p.k = n.up AND n.d > 0
"""

#: Every anchor against every row, as inner products of whole numbers in doubles, which hold them exactly.
HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""

#: Of equal payloads the largest page_id is the response; base32 of SHA-1 from groups of five hexadecimal digits.
ARCHIVES = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         row_number() OVER w AS place, first_value(page_id) OVER w AS best
  FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)),
d AS (SELECT *, [CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)] AS five FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN best END AS refers_to
FROM d
"""
