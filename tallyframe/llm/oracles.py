"""Independent SQL for the operators that whole-number SQL can express."""

from __future__ import annotations


def clusters(count: int, rounds: int, width: int) -> str:
    """Centroids moved ``rounds`` times, every vector measured against each of them."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, min(c) AS c, min(d) AS d FROM (
    SELECT vec_id, c, d, min(d) OVER (PARTITION BY vec_id) AS least FROM (
      SELECT k.vec_id, m.c, sum((k.x - m.x) * (k.x - m.x)) AS d
      FROM component k JOIN c{r} m ON k.i = m.i GROUP BY k.vec_id, m.c))
  WHERE d = least GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN (
    SELECT a.c, k.i, (sum(k.x) - ((sum(k.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM a{r} a JOIN component k ON a.vec_id = k.vec_id GROUP BY a.c, k.i
  ) n ON o.c = n.c AND o.i = n.i)""")
    return f"""
WITH component AS MATERIALIZED (
  SELECT vec_id, unnest(list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT)) AS x,
    unnest(range({width})) AS i
  FROM embeddings
  WHERE len(embedding) = {width}
    AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v::DOUBLE))) = {width}),
c0 AS MATERIALIZED (
  SELECT s.c, k.i, k.x FROM component k JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c
    FROM (SELECT DISTINCT vec_id FROM component)
    ORDER BY c LIMIT {count}
  ) s ON k.vec_id = s.vec_id),{",".join(steps)},
digest AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance,
  sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  g.sha AS centroid_sha256
FROM a{rounds} a JOIN digest g ON a.c = g.c"""


NEGATIVES = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v::DOUBLE))) = len(embedding)),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM kept a, kept b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""
