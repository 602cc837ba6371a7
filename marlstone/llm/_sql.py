"""SQL of the operators whose rows SQL can state."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 from its polynomial: a table of 256 by rule, and a fold over the bytes of a column k.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, b: xor(c >> 1, (c & 1) * 3988292384))) AS t"


def _crc(k: str) -> str:
    some = f"list_transform(range(octet_length(encode({k}))), lambda i: ('0x' || substr(hex(encode({k})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {some}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


RESAMPLE = rf"""
WITH tab AS ({_CRC_TABLE}),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS k FROM benchmark),
flat AS MATERIALIZED (SELECT doc_id, unnest(w) AS k FROM docs),
code AS MATERIALIZED (SELECT k, {_crc("k")} % 10000 AS b FROM (SELECT k FROM flat UNION SELECT k FROM wanted), tab),
s AS (SELECT b, count(*) AS s FROM flat JOIN code USING (k) GROUP BY b), t AS (SELECT b, count(*) AS t FROM wanted JOIN code USING (k) GROUP BY b),
tot AS (SELECT (SELECT count(*) FROM flat) AS n_s, (SELECT count(*) FROM wanted) AS n_t),
gains AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (n_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (n_t + 10000)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (b), tot),
mean AS (SELECT doc_id, floor(sum(g) / count(*))::BIGINT AS weight FROM flat JOIN code USING (k) JOIN gains USING (b) GROUP BY doc_id),
noise AS (SELECT doc_id, len(w) AS n_features, floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS e FROM docs),
scored AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + e AS score FROM noise LEFT JOIN mean USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)"""

REPAIR = rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fated AS MATERIALIZED (SELECT conv_id, turn, role, text, {_crc("k")} % 20 AS f FROM keyed, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM hurt),
rows AS MATERIALIZED (SELECT conv_id, turn, role, text, i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, left(role, 1) AS l, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS l0 FROM placed),
tally AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (l0 || l NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
edits AS MATERIALIZED (SELECT conv_id, i, s, e, c, z FROM (
  SELECT conv_id, i, s, 'D' AS e, 3 AS c, s AS z FROM rows, (SELECT unnest([0, 1, 2, 3]) AS s)
  UNION ALL SELECT conv_id, i, s, 'K', (fault = 't')::INT, z FROM rows JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS m(s, r, z) ON l = r WHERE fault IN ('', 't')
  UNION ALL SELECT conv_id, i, s, 'R', 2 + (fault = 't')::INT, z FROM rows, (VALUES (0, 2), (1, 2), (3, 2), (2, 3)) AS m(s, z) WHERE fault IN ('', 't'))),
steps AS MATERIALIZED (SELECT conv_id, i, list({{'s': s, 'c': c, 'z': z}}) AS es FROM edits GROUP BY conv_id, i),
go(conv_id, i, v) AS (SELECT conv_id, n + 1, [0, 4, 2, 0] FROM tally
  UNION ALL SELECT conv_id, i - 1, [least(u[1], 2 + least(u[3], 2 + u[4])), least(u[2], 2 + least(u[3], 2 + u[4])), least(u[3], 2 + u[4]), least(u[4], 2 + u[3])]
  FROM (SELECT go.conv_id, go.i, list_transform([0, 1, 2, 3], lambda q: list_min(list_transform(list_filter(es, lambda x: x.s = q), lambda x: x.c + go.v[x.z + 1]))) AS u
    FROM go JOIN steps ON steps.conv_id = go.conv_id AND steps.i = go.i - 1)),
costs AS MATERIALIZED (SELECT conv_id, i, unnest([0, 1, 2, 3]) AS s, unnest(v) AS v FROM go),
ways AS MATERIALIZED (SELECT x.conv_id, x.i, x.s, min({{'e': e, 'i': j, 'z': z}}) AS w FROM (
  SELECT conv_id, i, s, e, c, z, i + 1 AS j FROM edits UNION ALL SELECT conv_id, i, s, 'I', 2, CASE s WHEN 2 THEN 3 ELSE 2 END, i FROM costs) AS x
  JOIN costs h ON h.conv_id = x.conv_id AND h.i = x.i AND h.s = x.s JOIN costs k ON k.conv_id = x.conv_id AND k.i = x.j AND k.s = x.z WHERE h.v = x.c + k.v GROUP BY ALL),
walk(conv_id, i, s, audit, said) AS (SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM tally
  UNION ALL SELECT walk.conv_id, w.i, w.z, audit || w.e, CASE w.e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, r.role || ':' || r.text)
    ELSE list_append(said, CASE walk.s WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE w.e WHEN 'R' THEN r.text ELSE '' END) END
  FROM walk JOIN ways ON ways.conv_id = walk.conv_id AND ways.i = walk.i AND ways.s = walk.s LEFT JOIN rows r ON r.conv_id = walk.conv_id AND r.i = walk.i),
ended AS (SELECT walk.conv_id, audit, said FROM walk JOIN tally USING (conv_id) WHERE walk.i = n + 1 AND walk.s IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY walk.conv_id ORDER BY length(audit) DESC) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN tally USING (conv_id) LEFT JOIN go USING (conv_id) LEFT JOIN ended USING (conv_id) WHERE go.i = 1 OR go.i IS NULL"""
