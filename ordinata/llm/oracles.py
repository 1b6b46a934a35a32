"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from ordinata.llm.urlfilter import LINK, LOWER, UPPER

#: Components by links: the least id that a walk over links reaches.
_REACH = """reach AS (
  SELECT a AS v, a AS r FROM pairs UNION SELECT pairs.b AS v, reach.r FROM reach JOIN pairs ON pairs.a = reach.v
), comp AS (SELECT v, min(r) AS r FROM reach GROUP BY v)"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), pairs AS (SELECT a, b FROM link UNION SELECT b, a FROM link), {_REACH}
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(coalesce(r, s.doc_id), s.doc_id) AS component_id FROM s LEFT JOIN comp ON v = s.doc_id
"""

EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (
  SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 3) || left(nxt, n // 3)) AS edited_sha256 FROM n
"""

NEAR = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), pairs AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE CASE WHEN len(p.x) = len(q.x) THEN list_cosine_similarity(p.x, q.x) >= 0.93 END
), {_REACH}, n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(coalesce(r, vec_id), vec_id) AS component_id, least(coalesce(r, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON v = vec_id LEFT JOIN n ON n.a = vec_id
"""


def urls(rules: list[tuple[str, str, str]], damping: float = 0.85, rounds: int = 16) -> str:
    """The walk of `urlfilter.spread`, a step after another."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in rules)
    link = LINK.replace("'", "''")
    steps = ["r0 AS (SELECT * FROM start)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(r) AS r FROM (SELECT * FROM start UNION ALL SELECT w.kind, w.dst, w.w * r.r FROM w JOIN r{i} r ON r.kind = w.kind AND r.host = w.src) GROUP BY kind, host)")
    return f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {values}), p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), fit AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS v
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path
), seeds AS (
  SELECT CASE WHEN v = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, CAST(count(*) AS DOUBLE) AS mass FROM fit WHERE v IS NOT NULL AND host <> '' GROUP BY ALL
), hosts AS (SELECT DISTINCT host FROM p), up AS (
  SELECT * FROM (SELECT host AS src, regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) AS dst, 1.0 AS n FROM hosts) WHERE dst <> ''
), l AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM p) WHERE src <> '' AND src <> dst GROUP BY src, dst
  UNION ALL SELECT src, dst, n FROM up UNION ALL SELECT dst, src, n FROM up
), e AS (SELECT kind, src, dst, sum(n) AS n FROM (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l) GROUP BY ALL
), w AS MATERIALIZED (SELECT kind, src, dst, {damping} * n / sum(n) OVER (PARTITION BY kind, src) AS w FROM e
), start AS MATERIALIZED (SELECT kind, host, {1 - damping} * mass / sum(mass) OVER (PARTITION BY kind) AS r FROM seeds
), {', '.join(steps)}, score AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN r ELSE 0 END) AS t, sum(CASE WHEN kind = 'distrust' THEN r ELSE 0 END) AS d FROM r{rounds} GROUP BY host
)
SELECT page_id, fit.host, path, rule, coalesce(v, CASE WHEN coalesce(d, 0) - coalesce(t, 0) > 1e-12 THEN 'block' ELSE 'allow' END) AS verdict FROM fit LEFT JOIN score ON score.host = fit.host
"""
