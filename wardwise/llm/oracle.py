"""What SQL can say of the operators, over the same tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, i, md5(hex(b[i:i + 49])) AS k FROM d, unnest(range(1, n - 48)) AS t(i) WHERE n >= 50),
first AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN first USING (k) WHERE d < doc_id),
island AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY doc_id, g),
gap AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS x, a - 1 AS y FROM island UNION ALL SELECT doc_id, max(z) + 1, NULL FROM island GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(hex(b[x:coalesce(y, n)]), '' ORDER BY x) AS h FROM gap g JOIN d USING (doc_id) WHERE x <= coalesce(y, n) GROUP BY g.doc_id),
cut AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM island GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

OP10_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM w, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
first AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE d < doc_id),
cut AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(ws[p], ' ' ORDER BY p) AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE doc_id IN (SELECT doc_id FROM cut)) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(CASE WHEN removed IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM w LEFT JOIN cut ON cut.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
