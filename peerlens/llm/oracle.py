"""SQL of the problems whose result SQL can state, for comparison on whole tables.

The others are tested on small fixtures: token ids (6) need a vocabulary, so SQL checks their round trip, and
truncation (8) is a model's judgement.
"""

_WORDS = r"regexp_extract_all(lower({0}), '[a-z0-9]+')"

P1 = """
WITH u AS (SELECT DISTINCT ON (vec_id) vec_id, CAST(mat AS DOUBLE[]) AS v FROM vector_matrix
  WHERE len(mat) = 64 AND len(list_filter(mat, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(mat, lambda x: x <> 0)) > 0 ORDER BY vec_id),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM u),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v) / (a.n * b.n), 6) AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE s >= 0.85)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 10"""

P2 = """
WITH f AS (SELECT lpad(trim(focal_firm), 10, '0') AS focal_firm, year, lpad(trim(peer_firm), 10, '0') AS peer_firm, score FROM peer_ranking
  WHERE trim(focal_firm) <> '' AND trim(peer_firm) <> '' AND score BETWEEN 0 AND 100 AND NOT isnan(score)),
g AS (SELECT focal_firm, year, peer_firm, max(score) AS score FROM f WHERE focal_firm <> peer_firm GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY focal_firm, year ORDER BY score DESC, peer_firm) AS k FROM g)
SELECT focal_firm, year, peer_firm FROM r WHERE k <= 10"""

_BOUNDARIES = r"""WITH RECURSIVE t AS (SELECT DISTINCT row_id, text_content AS x, CAST(length(text_content) AS BIGINT) AS n FROM filing_item WHERE length(text_content) > 2000),
w AS (SELECT row_id, x, unnest(range(0, n)) AS i, unnest(string_split(x, '')) IN (' ', chr(9), chr(10), chr(13)) AS ws FROM t),
l AS (SELECT row_id, x, i, ws, lag(ws) OVER (PARTITION BY row_id ORDER BY i) AS after_ws, max(CASE WHEN NOT ws THEN i END) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS a FROM w),
b AS (SELECT row_id, i AS p, CASE WHEN length(x[a + 1 : i]) - length(replace(x[a + 1 : i], chr(10), '')) >= 2 THEN 2 WHEN regexp_matches(x[greatest(1, a - 1) : a], '[.!?]["'')”’]?$') THEN 1 ELSE 0 END AS kind FROM l WHERE NOT ws AND after_ws AND a IS NOT NULL),"""

P3 = _BOUNDARIES + r"""
r AS (
  SELECT row_id, n, CAST(0 AS BIGINT) AS start_pos, CASE WHEN n <= 2000 THEN n ELSE coalesce((SELECT max(p) FROM b WHERE b.row_id = t.row_id AND kind = 2 AND p > 1000 AND p <= 2000), (SELECT max(p) FROM b WHERE b.row_id = t.row_id AND kind = 1 AND p > 1000 AND p <= 2000), (SELECT max(p) FROM b WHERE b.row_id = t.row_id AND kind = 0 AND p > 1000 AND p <= 2000), 2000) END AS end_pos FROM t
  UNION ALL
  SELECT row_id, n, s, CASE WHEN n - s <= 2000 THEN n ELSE coalesce((SELECT max(p) FROM b WHERE b.row_id = q.row_id AND kind = 2 AND p > s + 1000 AND p <= s + 2000), (SELECT max(p) FROM b WHERE b.row_id = q.row_id AND kind = 1 AND p > s + 1000 AND p <= s + 2000), (SELECT max(p) FROM b WHERE b.row_id = q.row_id AND kind = 0 AND p > s + 1000 AND p <= s + 2000), s + 2000) END
  FROM (SELECT row_id, n, coalesce((SELECT min(p) FROM b WHERE b.row_id = r.row_id AND p >= end_pos - 200 AND p < end_pos), end_pos - 200) AS s FROM r WHERE end_pos < n) q)
SELECT row_id, start_pos, end_pos FROM r"""

_NEAREST = "(SELECT arg_min(p, abs(p - (s.a + s.b) // 2) * 10000000 + p) FROM b WHERE b.row_id = s.row_id AND kind = {0} AND abs(p - (s.a + s.b) // 2) <= (s.b - s.a) // 4 AND p > s.a AND p < s.b)"

P3_BISECT = _BOUNDARIES + f"""
s AS (SELECT row_id, CAST(0 AS BIGINT) AS a, n AS b FROM t
  UNION ALL SELECT row_id, CASE WHEN half = 0 THEN a ELSE cut END, CASE WHEN half = 0 THEN cut ELSE b END
  FROM (SELECT row_id, a, b, coalesce({_NEAREST.format(2)}, {_NEAREST.format(1)}, {_NEAREST.format(0)}, (a + b) // 2) AS cut FROM s WHERE b - a > 1800) q, (VALUES (0), (1)) h(half))
SELECT row_id, CASE WHEN a = 0 THEN 0 ELSE coalesce((SELECT min(p) FROM b WHERE b.row_id = s.row_id AND p >= s.a - 200 AND p < s.a), a - 200) END AS start_pos, s.b AS end_pos FROM s WHERE s.b - a <= 1800"""

P4 = f"""
WITH w AS (SELECT row_id, {_WORDS.format('text_content')} AS w FROM filing_item WHERE text_content IS NOT NULL),
s AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT row_id, count(*) AS n FROM s GROUP BY row_id),
b AS (SELECT a.row_id AS row_a, b.row_id AS row_b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.row_id < b.row_id GROUP BY ALL)
SELECT row_a, row_b FROM b JOIN n x ON x.row_id = row_a JOIN n y ON y.row_id = row_b WHERE 10 * n_both >= 6 * (x.n + y.n - n_both)"""

P5 = """
WITH w AS (SELECT row_id, i AS start_pos, md5(text_content[i + 1 : i + 200]) AS h FROM (SELECT row_id, text_content, unnest(range(0, length(text_content) - 199)) AS i FROM filing_item WHERE length(text_content) >= 200)),
m AS (SELECT h FROM w GROUP BY h HAVING min(row_id) < max(row_id)),
p AS (SELECT row_id, start_pos, start_pos - lag(start_pos) OVER (PARTITION BY row_id ORDER BY start_pos) AS gap FROM w JOIN m USING (h)),
g AS (SELECT row_id, start_pos, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY start_pos) AS g FROM p)
SELECT row_id, min(start_pos) AS start_pos, max(start_pos) + 200 AS end_pos FROM g GROUP BY row_id, g.g"""

P7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT passage_id, {_WORDS.format('passage')} AS w FROM eval_passages WHERE passage IS NOT NULL),
x AS (SELECT doc_id, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
y AS (SELECT passage_id, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT passage_id, w, unnest(range(1, len(w) - 11)) AS i FROM p))
SELECT DISTINCT doc_id, passage_id FROM x JOIN y USING (s)"""

# two edits leave one of three blocks of eight words as it was, moved by one word at most
P7_EDITED = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT passage_id, {_WORDS.format('passage')} AS w FROM eval_passages WHERE passage IS NOT NULL),
x AS (SELECT doc_id, w[i : i + 23] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) - 22)) AS i FROM d)),
y AS (SELECT passage_id, w[i : i + 23] AS a FROM (SELECT passage_id, w, unnest(range(1, len(w) - 22)) AS i FROM p)),
gx AS (SELECT doc_id, b, k, array_to_string(b[k + s + 1 : k + s + 8], ' ') AS g FROM x, (VALUES (0), (8), (16)) v(k), (VALUES (-1), (0), (1)) u(s) WHERE k + s >= 0 AND k + s + 8 <= 24),
gy AS (SELECT passage_id, a, k, array_to_string(a[k + 1 : k + 8], ' ') AS g FROM y, (VALUES (0), (8), (16)) v(k)),
c AS (SELECT DISTINCT doc_id, passage_id, a, b FROM gx JOIN gy USING (k, g)),
e AS (SELECT *, list_filter(range(1, 25), lambda i: a[i] <> b[i]) AS o FROM c)
SELECT DISTINCT doc_id, passage_id FROM e WHERE len(o) <= 2 OR a[o[1] + 1 : o[-1]] = b[o[1] : o[-1] - 1] OR a[o[1] : o[-1] - 1] = b[o[1] + 1 : o[-1]]"""

P5_SHARE = f"""
WITH f AS ({P5}),
s AS (SELECT row_id, CAST(sum(end_pos - start_pos) AS BIGINT) AS shared FROM f GROUP BY row_id),
r AS (SELECT row_id, max(length(text_content)) AS n_chars FROM filing_item GROUP BY row_id)
SELECT row_id, n_chars, coalesce(shared, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN round(coalesce(shared, 0) / n_chars, 6) END AS share FROM r LEFT JOIN s USING (row_id)"""

_BLANK, _ANY = r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)[ \t\r\n]*", r"[^\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"

P5_PARAGRAPHS = f"""
WITH RECURSIVE t AS (SELECT DISTINCT row_id, regexp_split_to_array(text_content, '{_BLANK}') AS p, list_append(regexp_extract_all(text_content, '{_BLANK}'), '') AS s FROM filing_item WHERE text_content IS NOT NULL),
q AS (SELECT row_id, i, p[i] AS text, CAST(coalesce(list_sum(list_transform(range(1, i), lambda k: length(p[k]) + length(s[k]))), 0) AS BIGINT) AS start_pos FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM t)),
g AS (SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS INT) AS paragraph, start_pos, start_pos + length(text) AS end_pos, text FROM q WHERE regexp_matches(text, '{_ANY}')),
n AS (SELECT *, row_id || ':' || paragraph AS name, {_WORDS.format('text')} AS w FROM g),
sh AS (SELECT DISTINCT name, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS i FROM n WHERE len(w) >= 20)),
c AS (SELECT name, count(*) AS c FROM sh GROUP BY name),
b AS (SELECT l.name AS a, r.name AS b, count(*) AS n_both FROM sh l JOIN sh r ON l.x = r.x AND l.name <> r.name GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN c x ON x.name = a JOIN c y ON y.name = b WHERE 10 * n_both >= 8 * (x.c + y.c - n_both) UNION SELECT l.name, r.name FROM n l JOIN n r ON l.text = r.text AND l.name <> r.name),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
roots AS (SELECT a AS name, least(a, min(b)) AS cluster FROM reach GROUP BY a)
SELECT row_id, paragraph, start_pos, end_pos, cluster, name <> cluster AS removable FROM n JOIN roots USING (name)"""

P6 = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"

SQL = {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_bisect": P3_BISECT, "p4_found": P4, "p5_found": P5, "p5_share": P5_SHARE, "p5_paragraphs": P5_PARAGRAPHS, "p6_round_trip": P6, "p7_found": P7, "p7_edited": P7_EDITED}
