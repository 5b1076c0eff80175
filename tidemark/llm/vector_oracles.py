"""DuckDB SQL for the vector operators: the rounds written out one after the other."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
# floor(sum / count) in integers.
_FLOOR = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT)"


def codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, embedding AS v FROM embeddings WHERE {_FINITE})",
        f"""cells AS MATERIALIZED (
  SELECT vec_id, CAST((j - 1) // step AS INT) AS p, CAST((j - 1) % step AS INT) AS d,
         CAST(floor({scale} * CAST(v[j] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, v, len(v) // {parts} AS step, unnest(range(1, len(v) + 1)) AS j FROM kept))""",
        f"""starts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries})""",
        "book0 AS MATERIALIZED (SELECT p, e, d, x AS c FROM cells JOIN starts USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, p, unnest(least_one) FROM (
    SELECT vec_id, p, min({{'error': error, 'e': e}}) AS least_one FROM (
      SELECT vec_id, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS error
      FROM cells JOIN book{r} USING (p, d) GROUP BY ALL) GROUP BY ALL))"""
        )
        if r < rounds:
            ctes.append(
                f"""book{r + 1} AS MATERIALIZED (
  SELECT p, e, d, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, d, {_FLOOR} AS c FROM cells JOIN near{r} USING (vec_id, p) GROUP BY ALL) m USING (p, e, d))"""
            )
    ctes.append(
        f"""coded AS MATERIALIZED (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)"""
    )
    return f"""WITH {",".join(ctes)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, d)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


def clusters(clusters: int = 40, rounds: int = 5, scale: int = 256, width: int = 64, seed: str = "2:") -> str:
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, embedding AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = {width})",
        f"""cells AS MATERIALIZED (
  SELECT vec_id, d, CAST(floor({scale} * CAST(v[d] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, v, unnest(range(1, {width + 1})) AS d FROM kept))""",
        f"""starts AS (
  SELECT vec_id, CAST(row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1 AS INT) AS cluster
  FROM kept QUALIFY cluster < {clusters})""",
        "centre0 AS MATERIALIZED (SELECT cluster, d, x AS c FROM cells JOIN starts USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, unnest(least_one) FROM (
    SELECT vec_id, min({{'distance': distance, 'cluster': cluster}}) AS least_one FROM (
      SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance
      FROM cells JOIN centre{r} USING (d) GROUP BY ALL) GROUP BY ALL))"""
        )
        if r < rounds:
            ctes.append(
                f"""centre{r + 1} AS MATERIALIZED (
  SELECT cluster, d, coalesce(m.c, b.c) AS c FROM centre{r} b LEFT JOIN (
    SELECT cluster, d, {_FLOOR} AS c FROM cells JOIN near{r} USING (vec_id) GROUP BY ALL) m USING (cluster, d))"""
            )
    return f"""WITH {",".join(ctes)},
digests AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM centre{rounds} GROUP BY 1)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN digests USING (cluster)"""
