"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .url_filter import BLOCK_GLOBS, DOMAIN_RULES

EXACT = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), t AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT x AS doc_id, x AS other FROM p
  UNION
  SELECT r.doc_id, p.y FROM r JOIN p ON r.other = p.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(min(r.other), s.doc_id) AS component_id
FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""


SUFFIX = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT k, i, b[i:i + 199] AS w FROM d, unnest(range(1, octet_length(b) - 198)) t(i)
), r AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY w) AS n FROM w) WHERE n > 1
), f AS (
  SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r
), g AS (
  SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS span FROM f
), s AS (
  SELECT k, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY k, span
), p AS (
  SELECT k, a, z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM s
), c AS (
  SELECT k, sum(z - a + 1) AS n_removed, count(*) AS n_spans, string_agg(hex(b[before + 1:a - 1]), '' ORDER BY a) AS head, max(z) AS last
  FROM p JOIN d USING (k) GROUP BY k
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(b[coalesce(last, 0) + 1:octet_length(b)]))) AS kept_sha256
FROM d LEFT JOIN c USING (k)
"""


def _glob_regex(glob: str) -> str:
    special = {"*": ".*", "?": "."}
    return "".join(special.get(c) or ("\\" + c if c in ".-+()[]{}|^$\\/" and c not in "-/" else c) for c in glob)


def url_sql() -> str:
    ranked = sorted(DOMAIN_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked)
    globs = "|".join(_glob_regex(g) for g in BLOCK_GLOBS)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH u AS (
  SELECT page_id, {lower("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^.*?://[^?#]*([?][^#]*)', 1, 's') AS query
  FROM pages
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {said} WHEN regexp_full_match(host || {lower("path || query")}, '(?s){globs}') THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": EXACT, "op2_suffix_dedup": SUFFIX, "op3_jaccard_join": NEAR, "op4_url_filter": url_sql(), "op5_exact_topk": TOP_K}
