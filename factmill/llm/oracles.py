"""DuckDB SQL for the queries of this subpackage that SQL can express; each judges whole tables."""

_COMPONENTS = """
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
component AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
"""

OP4 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), {_COMPONENTS}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.a = d.doc_id
"""

OP6 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM docs)
), firsts AS (SELECT s, min(doc_id) AS f, count(*) FROM starts GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM starts JOIN firsts USING (s) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits),
bytes AS (
  SELECT b.doc_id, b.p, b.x, g.p IS NOT NULL AS cut
  FROM (SELECT doc_id, unnest(range(0, length(h) // 2)) AS p, unnest(list_transform(range(0, length(h) // 2), lambda k: substr(h, 2 * k + 1, 2))) AS x FROM docs WHERE doc_id IN (SELECT doc_id FROM hits)) b
  LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p
), marked AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM bytes),
cuts AS (
  SELECT doc_id, count(*) FILTER (cut) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT cut), '') AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(c.kept, d.h))) AS kept_sha256
FROM docs d LEFT JOIN cuts c ON c.doc_id = d.doc_id
"""

OP7 = """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM line
), norm AS (SELECT *, array_to_string(w, ' ') AS t, len(w) AS n FROM worded WHERE len(w) > 0),
firsts AS (SELECT t, any_value(w) AS w, any_value(n) AS n, min({'d': doc_id, 'l': line_no}) AS f FROM norm GROUP BY t),
variants AS (
  SELECT t, n, f, i, array_to_string(w[1:i - 1], ' ') || chr(2) || array_to_string(w[i + 1:], ' ') AS v, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS c
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 5)
), same AS (SELECT n, i, v, min(f) AS f FROM variants GROUP BY ALL),
losers AS (
  SELECT a.t FROM variants a JOIN same b ON a.n = b.n AND a.i = b.i AND a.v = b.v AND b.f < a.f
  UNION SELECT a.t FROM firsts a JOIN variants b ON b.c = a.t AND a.n >= 5 AND b.f < a.f
  UNION SELECT b.t FROM firsts a JOIN variants b ON b.c = a.t AND a.n >= 5 AND a.f < b.f
), judged AS (
  SELECT n.doc_id, n.line_no, f.f <> {'d': n.doc_id, 'l': n.line_no} AS equal, l.t IS NOT NULL AND f.f = {'d': n.doc_id, 'l': n.line_no} AS near
  FROM norm n JOIN firsts f ON f.t = n.t LEFT JOIN losers l ON l.t = n.t
), counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (equal OR near) AS n_removed, count(*) FILTER (near) AS n_near FROM judged GROUP BY doc_id
), texts AS (
  SELECT line.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS kept FROM line LEFT JOIN judged j USING (doc_id, line_no) WHERE NOT coalesce(j.equal OR j.near, false) GROUP BY line.doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_near, 0) AS n_near, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN texts t ON t.doc_id = d.doc_id
"""

OP9 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), unit AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
linked AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) AND x.norm > 0 AND y.norm > 0
  WHERE list_inner_product(x.e, y.e) >= 0.9 * x.norm * y.norm
), {_COMPONENTS},
links AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id, e.vec_id = coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN component c ON c.a = e.vec_id LEFT JOIN links l ON l.a = e.vec_id
"""

OP10 = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)
), firsts AS (SELECT s, min(doc_id) AS f FROM starts GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM starts JOIN firsts USING (s) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hits),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM docs),
cuts AS (
  SELECT w.doc_id, count(g.p) AS n_removed, coalesce(string_agg(w.x, ' ' ORDER BY w.p) FILTER (g.p IS NULL), '') AS kept
  FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN cuts c ON c.doc_id = d.doc_id
"""

OP11 = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))),
freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM freq WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k > 1 AND f >= 100),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND o.a >= c.a)),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:k], ' ') AS s FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.j, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN total t USING (lang) JOIN freq l ON l.lang = c.lang AND l.phrase = c.p JOIN freq r ON r.lang = c.lang AND r.phrase = c.s
), lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
