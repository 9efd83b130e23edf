"""DuckDB SQL of the operators 11 to 13."""

from __future__ import annotations

from ledgerline.llm import clusters, mixing

OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap, place, CASE place % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM s
), f AS (
  SELECT *, cap / weight::DOUBLE AS level, coalesce(sum(cap) OVER b, 0) AS caps, coalesce(sum(weight) OVER b, 0) AS weights,
    sum(source_size) OVER () AS words, sum(weight) OVER () AS all_weights
  FROM w WINDOW b AS (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), j AS (
  SELECT *, caps + level * (all_weights - weights) < words AS is_full FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE
    ELSE (words - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM j
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS copy FROM d
), k AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '-') || ':' || size || ':' || copy // {mixing.RUN}) AS key FROM n
), p AS (
  SELECT k.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM e
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id, s.r) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def _op13_sql() -> str:
    """One assignment and one move after the other; components are doubles that hold integers."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {clusters.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT k::INTEGER - 1 AS k, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) AS k FROM v) WHERE k <= {clusters.CENTROIDS})",
    ]
    for i in range(clusters.ROUNDS + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, k)) AS best FROM (SELECT r, vec_id, v, k, (list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT AS d FROM v, c{i}) GROUP BY r)"
        )
        if i < clusters.ROUNDS:
            steps.append(
                f"m{i} AS MATERIALIZED (SELECT k, list(s ORDER BY i) AS c FROM (SELECT k, i, floor(sum(x) / count(*)) AS s FROM (SELECT best[2] AS k, unnest(v) AS x, unnest(range({clusters.DIMS})) AS i FROM a{i}) GROUP BY k, i) GROUP BY k)"
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    last = clusters.ROUNDS
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, best[2] AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON k = best[2]"""
    )


OP13_SQL = _op13_sql()
