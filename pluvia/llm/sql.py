"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op4_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT AS h
  FROM documents),
dealt AS (SELECT greatest(64, pow(2, ceil(log2(greatest(coalesce(sum(size), 0), 1) / 33554432.0::DOUBLE))))::BIGINT AS shards FROM sized),
light AS (SELECT *, h % (SELECT shards FROM dealt) AS shard FROM sized),
cells AS (SELECT source, shard, sum(size)::BIGINT AS cell_size FROM light GROUP BY ALL),
s0 AS (SELECT source, sum(cell_size)::BIGINT AS source_size FROM cells GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *,
         coalesce(sum(cap) OVER f, 0)::DOUBLE AS filled, coalesce(sum(weight) OVER f, 0)::DOUBLE AS spent,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, (sum(weight) OVER ())::DOUBLE AS weights
       FROM s2 WINDOW f AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (budget - filled) / (weights - spent) AS level FROM s3),
s5 AS (SELECT *, least(cap::DOUBLE, weight * coalesce(max(CASE WHEN cap >= weight * level THEN level END) OVER (), 0.0::DOUBLE)) AS target FROM s4),
s6 AS (SELECT *, floor((sum(target ORDER BY rank) OVER ()) / 16 + 0.5)::BIGINT AS seats FROM s5),
q1 AS (SELECT rank, target, seats, k FROM s6, LATERAL (SELECT unnest(generate_series(0::BIGINT, floor(target / 16)::BIGINT + 64)) AS k) WHERE target > 0),
q2 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place FROM q1),
won AS (SELECT rank, count(*)::BIGINT AS blocks FROM q2 WHERE place <= seats GROUP BY ALL),
src AS (SELECT s6.*, coalesce(blocks, 0) AS blocks FROM s6 LEFT JOIN won USING (rank)),
c1 AS (SELECT cells.*, source_size, target, rank, blocks FROM cells JOIN src ON cells.source IS NOT DISTINCT FROM src.source),
c2 AS (SELECT rank, shard, cell_size, blocks, k FROM c1, LATERAL (SELECT unnest(generate_series(0::BIGINT, floor(blocks::DOUBLE * cell_size / source_size)::BIGINT + 64)) AS k) WHERE cell_size > 0),
c3 AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY cell_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place FROM c2),
c4 AS (SELECT rank, shard, count(*)::BIGINT AS quota FROM c3 WHERE place <= blocks GROUP BY ALL),
c5 AS (SELECT c1.*, least(coalesce(quota, 0) * 16, cell_size * 2) AS words FROM c1 LEFT JOIN c4 USING (rank, shard)),
c6 AS (SELECT *, CASE WHEN cell_size > 0 THEN words // cell_size ELSE 0 END AS times FROM c5),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM light)
SELECT doc_id, p.size, c6.source_size, c6.target,
       (times * p.size + greatest(0, least(e, words - times * cell_size) - (e - p.size)))::BIGINT AS taken
FROM placed p JOIN c6 ON p.shard = c6.shard AND p.source IS NOT DISTINCT FROM c6.source
"""

SQL["op10_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS grams FROM w),
x AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs WHERE 100 * i >= 85 * (nu + nv - i)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS to_id FROM s UNION SELECT reach.doc_id, v FROM reach JOIN both_ways ON u = to_id)
SELECT s.doc_id, any_value(len(grams))::BIGINT AS n_shingles, min(to_id) AS component_id, s.doc_id = min(to_id) AS kept
FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id
"""

SQL["op2_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

SQL["op3_embedding_dedup"] = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
   AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id, vec_id AS to_id FROM e UNION SELECT reach.vec_id, links.v FROM reach JOIN links ON links.u = to_id),
deg AS (SELECT u, count(*) AS n FROM links GROUP BY ALL)
SELECT e.vec_id, any_value(coalesce(deg.n, 0))::BIGINT AS n_links, min(to_id) AS component_id, e.vec_id = min(to_id) AS kept
FROM e JOIN reach ON e.vec_id = reach.vec_id LEFT JOIN deg ON deg.u = e.vec_id GROUP BY e.vec_id
"""


def _repair_sql() -> str:
    """Turn by turn, the cheapest label of each state: cost in nine digits, then the audit, so that labels compare as text."""

    def longer(x: str, add: str, letter: str) -> str:
        return f"lpad((left({x}, 9)::BIGINT + {add})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}'"

    def if_(ok: str, x: str) -> str:
        return f"CASE WHEN {ok} THEN {x} ELSE '900000000' END"

    mark = "md5(octet_length(encode(role))::VARCHAR || ':' || role || text)"
    return rf"""
WITH RECURSIVE k0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k1 AS (
  SELECT *, xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS k FROM k0),
d0 AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k1),
d1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {mark}, copy) AS i FROM d0),
d2 AS (
  SELECT *, left(role, 1) AS r0, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM d1),
d3 AS (SELECT *, CASE WHEN lag(r0) OVER (PARTITION BY conv_id ORDER BY i) || r0 NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad, fault IN (0, 3) AS whole, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS cut FROM d2),
convs AS (SELECT DISTINCT conv_id FROM conversations),
stat AS (
  SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1)::BIGINT AS blank, count(*) FILTER (fault = 2)::BIGINT AS duplicate,
         count(*) FILTER (fault = 3)::BIGINT AS truncated, coalesce(sum(bad), 0)::BIGINT AS illegal, coalesce(max(i), 0) AS n
  FROM convs c LEFT JOIN d3 ON c.conv_id IS NOT DISTINCT FROM d3.conv_id GROUP BY c.conv_id),
lab AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS l0, '900000000' AS ls, '900000000' AS lu, '900000000' AS la FROM convs
  UNION ALL
  SELECT x.conv_id, d3.i, {longer("l0", "3", "D")}, least({longer("ls", "3", "D")}, {if_("whole AND r0 = 's'", longer("l0", "cut", "K"))}),
         least({longer("u1", "3", "D")}, {if_("whole AND r0 = 'u'", longer("least(l0, ls, a1)", "cut", "K"))}, {if_("whole", longer("least(l0, ls, a1)", "cut + 2", "R"))}),
         least({longer("a1", "3", "D")}, {if_("whole AND r0 = 'a'", longer("u1", "cut", "K"))}, {if_("whole", longer("u1", "cut + 2", "R"))})
  FROM (SELECT *, least(la, {longer("u1", "2", "I")}) AS a1 FROM (SELECT *, least(lu, {longer("l0", "2", "I")}, {longer("ls", "2", "I")}, {longer("la", "2", "I")}) AS u1 FROM lab)) x
  JOIN d3 ON x.conv_id IS NOT DISTINCT FROM d3.conv_id AND d3.i = x.i + 1),
fin AS (
  SELECT stat.*, least(l0, la, {longer("u1", "2", "I")}) AS best FROM stat
  JOIN (SELECT *, least(lu, {longer("l0", "2", "I")}, {longer("ls", "2", "I")}, {longer("la", "2", "I")}) AS u1 FROM lab) l ON stat.conv_id IS NOT DISTINCT FROM l.conv_id AND l.i = stat.n),
one AS (SELECT * EXCLUDE (best), left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit, length(replace(substr(best, 10), 'D', '')) AS m FROM fin),
let AS (SELECT conv_id, m, unnest(range(1, length(audit) + 1)) AS j, audit FROM one),
pos AS (SELECT *, audit[j] AS c, sum(CASE WHEN audit[j] = 'D' THEN 0 ELSE 1 END) OVER w - 1 AS p, sum(CASE WHEN audit[j] = 'I' THEN 0 ELSE 1 END) OVER w AS i FROM let WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
fixed AS (
  SELECT pos.conv_id, p, CASE WHEN c = 'K' THEN role WHEN (p - m % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END AS line
  FROM pos LEFT JOIN d3 ON pos.conv_id IS NOT DISTINCT FROM d3.conv_id AND pos.i = d3.i WHERE c <> 'D'),
told AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS s FROM fixed GROUP BY conv_id)
SELECT one.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, coalesce(s, sha256('')) AS repaired_sha256
FROM one LEFT JOIN told ON one.conv_id IS NOT DISTINCT FROM told.conv_id
"""


SQL["op11_repair"] = _repair_sql()
