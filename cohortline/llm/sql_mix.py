"""DuckDB SQL of the mixing query: the fill level in closed form (sources sorted by their
limit per weight), queues and finish times as window sums."""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS rnk
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS lim, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
o AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut_before,
         sum(weight) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM w),
c AS (SELECT *, lim * weight_from < (total - cut_before) * weight AS capped FROM o),
f AS (
  SELECT total - coalesce(sum(lim) FILTER (capped), 0) AS words, sum(weight) FILTER (NOT capped) AS weights FROM c GROUP BY total),
t AS (
  SELECT c.source, c.source_size, c.rnk, c.total,
         CASE WHEN c.total = 0 THEN 0.0::DOUBLE WHEN c.capped THEN CAST(c.lim AS DOUBLE)
              ELSE CAST(c.weight * f.words AS DOUBLE) / CAST(f.weights AS DOUBLE) END AS target
  FROM c CROSS JOIN f),
q AS (
  SELECT row_number() OVER () AS id, d.doc_id, d.size, t.source_size, t.target, t.rnk, t.total
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, sum(size) OVER (PARTITION BY rnk ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size, id
                            ROWS UNBOUNDED PRECEDING) AS words
  FROM q WHERE size > 0),
e AS (
  SELECT r.*, p.pass, CAST(p.pass * source_size + words AS DOUBLE) / target AS finish
  FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass) p),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rnk, words, pass ROWS UNBOUNDED PRECEDING) AS served FROM e),
k AS (SELECT id, CAST(sum(CASE WHEN served <= total THEN size ELSE 0 END) AS BIGINT) AS taken FROM g GROUP BY id)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, coalesce(k.taken, 0) AS taken
FROM q LEFT JOIN k ON q.id = k.id
"""
