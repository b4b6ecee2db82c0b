"""SQL that gives the rows of those queries whose answers their contracts fix. It compares everything with everything, so
it is for small tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAREST = """
WITH e AS (
  SELECT row_number() OVER () AS own, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id,
    sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM e q JOIN e c ON c.own <> q.own WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, unnest(range(0, strlen(x) // 2 - 199)) AS k, x FROM h WHERE strlen(x) >= 400),
g AS (SELECT doc_id, k, hash(substring(x, 2 * k + 1, 400)) AS g FROM s),
hit AS (SELECT doc_id, k FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
island AS (SELECT doc_id, k, coalesce(k > lag(k) OVER w + 200, true) AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
numbered AS (SELECT doc_id, k, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS i FROM island),
gone AS (SELECT doc_id, i, min(k) AS a, max(k) + 200 AS z FROM numbered GROUP BY doc_id, i),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM gone
  UNION ALL SELECT doc_id, max(z) AS a, NULL AS z FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN gap.z IS NULL THEN substring(x, 2 * gap.a + 1) ELSE substring(x, 2 * gap.a + 1, 2 * (gap.z - gap.a)) END, '' ORDER BY gap.a) AS y
  FROM gap JOIN h USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(strlen(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM h LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

WINDOWS = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS k, ws FROM d WHERE len(ws) >= 13),
g AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS g FROM p),
least AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM g JOIN least USING (g) WHERE m < doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS y, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(y, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS k FROM d WHERE len(ws) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN root ON root.a = d.doc_id"""


def sql() -> dict[str, str]:
    return {"op2_nearest": NEAREST, "op5_repeats": REPEATS, "op7_substrings": WINDOWS, "op8_near_duplicates": NEAR_DUPLICATES}
