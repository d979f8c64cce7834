"""SQL for the queries of this subpackage that SQL can express whole."""

from __future__ import annotations

from chunkloom.llm import secrets


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(kind: int) -> str:
    name, pattern, group, least = secrets.KINDS[kind]
    return f"""SELECT rid, doc_id, source, {kind} AS kind, '{name}' AS name, value, (ends - hit_len)::BIGINT AS s, ends::BIGINT AS e FROM (
      SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS ends, length(hit) AS hit_len FROM (
        SELECT rid, doc_id, source, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap FROM (
          SELECT rid, doc_id, source, regexp_extract_all(text, {_quoted(pattern)}) AS hits, regexp_extract_all(text, {_quoted(pattern)}, {group}) AS vals, regexp_split_to_array(text, {_quoted(pattern)}) AS gaps FROM d))) WHERE length(value) >= {least}"""


SECRETS = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({' UNION ALL '.join(_spans(k) for k in range(len(secrets.KINDS)))}),
o AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS n_owners FROM s GROUP BY value),
j AS (SELECT s.*, n_owners < {secrets.EXAMPLE_OWNERS} AS live FROM s JOIN o USING (value)),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN g USING (rid)"""

VECTORS = """WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM embeddings), v AS MATERIALIZED (SELECT rid, vec_id, label, embedding::DOUBLE[] AS x FROM e WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS MATERIALIZED (SELECT a.rid AS rid, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93),
l AS MATERIALIZED (SELECT DISTINCT a, b FROM p),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT rid, count(*) AS n_links FROM p GROUP BY rid)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept FROM e LEFT JOIN n ON n.rid = e.rid LEFT JOIN c ON c.a = e.vec_id"""

SHINGLES = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda t: t <> '') AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
k AS MATERIALIZED (SELECT doc_id, len(g) AS n, list_sort(g)::VARCHAR AS name FROM t),
m AS MATERIALIZED (SELECT name, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM k WHERE n > 0 GROUP BY name),
s AS MATERIALIZED (SELECT rep, n, unnest(g) AS s FROM m JOIN t ON t.doc_id = m.rep),
l AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM s a JOIN s b ON a.s = b.s AND a.rep <> b.rep AND b.n >= 0.8 * a.n AND a.n >= 0.8 * b.n GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
x AS (SELECT l.a, sum(m.copies) AS n FROM l JOIN m ON m.rep = l.b GROUP BY l.a)
SELECT k.doc_id, coalesce(c.class_id, m.rep, k.doc_id) AS class_id, (coalesce(x.n, 0) + coalesce(m.copies, 1) - 1)::BIGINT AS n_links, k.doc_id = coalesce(c.class_id, m.rep, k.doc_id) AS kept
FROM k LEFT JOIN m ON m.name = k.name LEFT JOIN c ON c.a = m.rep LEFT JOIN x ON x.a = m.rep"""

ORACLES = {"op3_embed_dedup": VECTORS, "op9_ngram_join": SHINGLES, "op10_secrets": SECRETS}
