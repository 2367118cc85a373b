"""DuckDB SQL of the vector code query: full scans in every round."""


def _assigned(entries: str) -> str:
    # least distance first, then least index: one number holds both
    return f"""SELECT r, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS m
  FROM parts JOIN {entries} USING (p) GROUP BY r, p"""


def _updated(entries: str, assigned: str) -> str:
    return f"""SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM {entries} o LEFT JOIN (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, m % 64 AS e, i, sum(x[i])::DOUBLE AS s, count(*) AS n
      FROM parts JOIN {assigned} USING (r, p), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY p, e) n
  ON o.p = n.p AND o.e = n.e"""


CODES_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, unnest(range(16)) AS t(p)),
e0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64),
a0 AS MATERIALIZED ({_assigned('e0')}),
e1 AS MATERIALIZED ({_updated('e0', 'a0')}),
a1 AS MATERIALIZED ({_assigned('e1')}),
e2 AS MATERIALIZED ({_updated('e1', 'a1')}),
a2 AS MATERIALIZED ({_assigned('e2')}),
coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(m % 64)), 2, '0'), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e2)
SELECT kept.vec_id, coded.code, coded.error,
       CAST(sum(coded.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error, book.codebooks_sha256
FROM kept JOIN coded USING (r) CROSS JOIN book
"""
