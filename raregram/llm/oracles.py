"""What some training-data queries give, said in SQL for DuckDB.

They state the definition, not the method: near-duplicate classes by all shared shingles, windows and repeated
strings by joins and counts on their content.
"""

from __future__ import annotations

#: Words of a text, A-Z as a-z.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN -row_number() OVER () ELSE dense_rank() OVER (ORDER BY text) END AS t FROM documents),
w AS (SELECT DISTINCT t, {_WORDS} AS w FROM d WHERE t > 0),
g AS (SELECT t, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
s AS (SELECT t, g, count(*) AS n FROM g GROUP BY t, g),
z AS (SELECT t, sum(n) AS n FROM s GROUP BY t),
m AS (SELECT a.t AS x, b.t AS y, sum(least(a.n, b.n)) AS m FROM s AS a JOIN s AS b ON a.g = b.g AND a.t < b.t GROUP BY a.t, b.t),
l AS (SELECT x, y FROM m JOIN z AS p ON p.t = x JOIN z AS q ON q.t = y WHERE 5 * m >= 4 * (p.n + q.n - m)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT d.doc_id, d.t, coalesce(least(d.t, o.t), d.t) AS c FROM d LEFT JOIN (SELECT x, min(y) AS t FROM r GROUP BY x) AS o ON d.t = o.x)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id FROM c
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT item, w, least(len(w), 8) AS k, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM p),
q AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) AS lengths),
o AS (SELECT r, i, q.k, item FROM q JOIN v ON q.k = v.k AND array_to_string(w[i : i + q.k - 1], ' ') = v.g),
h AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT r, i, k FROM o)) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(t.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

#: Texts as hexadecimal digits, cut into overlapping pieces only so that each string is near the start of one.
SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, pos, substr(h, 2 * pos + 1, 2 * 699) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 2, 500)) AS pos FROM d)),
s AS (SELECT r, pos + i AS i, md5_number(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT r, pos, h, unnest(range(0, least(500, len(h) // 2 - 199))) AS i FROM p)),
f AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
o AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM s WHERE m IN (SELECT m FROM f)),
n AS (SELECT r, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM o),
u AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY r, run),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM u),
x AS (SELECT r, count(*) AS runs, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""

ORACLES = {"op2_near_duplicates": NEAR_DUPLICATES, "op8_decontamination": DECONTAMINATION, "op9_suffix_dedup": SUFFIX_DEDUP}
