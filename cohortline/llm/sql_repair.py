"""DuckDB SQL of the conversation repair query: dynamic programming over rows and role
states (0 nothing, 1 system, 2 user, 3 assistant) instead of a search, CRC-32 by its table."""

_NEXT = "CASE {q} WHEN 2 THEN 3 ELSE 2 END"
_INS = "CASE {q} WHEN 2 THEN 'user:' ELSE 'assistant:' END"


def _join(rep: str, line: str) -> str:
    return f"CASE WHEN {rep} = '' THEN {line} ELSE {rep} || chr(10) || {line} END"


# up to two inserts follow each step; a third one leads back to a role state at more cost
_WITH_INSERTS = f"""
    SELECT conv, i, q, cost, audit, rep FROM step
    UNION ALL
    SELECT conv, i, {_NEXT.format(q='q')}, cost + 2, audit || 'I', {_join('rep', _INS.format(q='(' + _NEXT.format(q='q') + ')'))} FROM step
    UNION ALL
    SELECT conv, i, CASE WHEN q = 2 THEN 2 ELSE 3 END, cost + 4, audit || 'II',
           {_join('rep', "CASE WHEN q = 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END")} FROM step"""

REPAIR_SQL = f"""
WITH RECURSIVE
t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS tab
      FROM range(256) r(b)),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (
  SELECT src.*, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT),
                    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) % 20 AS kind
  FROM src CROSS JOIN t),
dam AS (
  SELECT coalesce('c' || conv_id::VARCHAR, 'n') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE kind <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM dam),
rws AS MATERIALIZED (
  SELECT *, left(role, 1) AS ini,
         CASE WHEN trimmed = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS prev, i AS at
  FROM num),
dp AS (
  SELECT conv, i, q, cost, audit, rep FROM (
    WITH step AS (SELECT DISTINCT conv, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS rep FROM rws) {_WITH_INSERTS})
  UNION ALL
  SELECT conv, i, q, best.cost, best.audit, best.rep FROM (
    SELECT conv, i, q, min({{'cost': cost, 'audit': audit, 'rep': rep}}) AS best FROM (
      WITH step AS (
        SELECT dp.conv, r.i, CASE o.a WHEN 'D' THEN dp.q WHEN 'K' THEN CASE WHEN r.ini = 's' THEN 1 ELSE {_NEXT.format(q='dp.q')} END
                                      ELSE {_NEXT.format(q='dp.q')} END AS q,
               dp.cost + CASE o.a WHEN 'D' THEN 3 WHEN 'K' THEN (r.fault = 'truncated')::BIGINT ELSE 2 + (r.fault = 'truncated')::BIGINT END AS cost,
               dp.audit || o.a AS audit,
               CASE o.a WHEN 'D' THEN dp.rep
                        WHEN 'K' THEN {_join('dp.rep', "r.role || ':' || r.text")}
                        ELSE {_join('dp.rep', "CASE dp.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text")} END AS rep
        FROM dp JOIN rws r ON dp.conv = r.conv AND r.i = dp.i + 1 CROSS JOIN (VALUES ('D'), ('K'), ('R')) o(a)
        WHERE o.a = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND CASE o.a
          WHEN 'K' THEN r.ini = CASE dp.q WHEN 2 THEN 'a' ELSE 'u' END OR (r.ini = 's' AND dp.q = 0)
          ELSE r.ini <> CASE dp.q WHEN 2 THEN 'a' ELSE 'u' END END)
      ) {_WITH_INSERTS}) GROUP BY conv, i, q)),
facts AS (
  SELECT conv, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rws GROUP BY conv),
best AS (
  SELECT dp.conv, min({{'cost': dp.cost, 'audit': dp.audit, 'rep': dp.rep}}) AS b
  FROM dp JOIN facts ON dp.conv = facts.conv AND dp.i = facts.n WHERE dp.q IN (0, 3) GROUP BY dp.conv)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(b.rep, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts ON coalesce('c' || c.conv_id::VARCHAR, 'n') = facts.conv
LEFT JOIN best ON facts.conv = best.conv
"""
