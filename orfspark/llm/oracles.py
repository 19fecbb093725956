"""The operators' definitions as SQL for DuckDB, by brute force, where SQL can state them. Ids are unique in these tables."""

#: Binary codes and brute force over all pairs of a query and a row; the other operators are beyond SQL.
HAMMING_SQL = """
WITH coded AS (
  SELECT vec_id, list_aggregate(list_transform(range(64), lambda i: CASE WHEN coalesce(embedding[i + 1], 0) > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), ranked AS (
  SELECT q.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.code, d.code), d.vec_id) AS rank,
         d.vec_id AS neighbor_id, hamming(q.code, d.code) AS distance
  FROM coded q CROSS JOIN coded d WHERE q.vec_id % 50 = 0
)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
"""

#: Every window and every word as a row.
SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT rid, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), recurring AS (
  SELECT rid, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT rid, k FROM (SELECT rid, unnest(range(i, i + 35)) AS k FROM recurring)
), words AS (
  SELECT rid, k, ws[k] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS k FROM d)
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, k) GROUP BY rid
)
SELECT rid AS doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

#: All pairs that share a shingle, and what links reach.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS digest FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sets p ON x = p.doc_id JOIN sets q ON y = q.doc_id WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), steps AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, s.y FROM reach r JOIN steps s ON r.other = s.x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(min(s.doc_id) OVER (PARTITION BY s.digest), d.doc_id) AS class_id,
       c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN sets s ON d.doc_id = s.doc_id JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON d.doc_id = c.node
"""

#: Lines, passages and threads by recursion.
QUOTES_SQL = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS mid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), split AS (
  SELECT mid, unnest(string_split_regex(text, '\r\n|\n|\r')) AS raw, generate_subscripts(string_split_regex(text, '\r\n|\n|\r'), 1) AS line
  FROM base WHERE regexp_matches(text, '(?m)^[ \t]*>')
), lines AS (
  SELECT mid, line, raw, length(regexp_replace(regexp_extract(raw, '^[ \t]*((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(raw, '^[ \t]*((?:>[ \t]?)*)', '') AS body
  FROM split
), told AS (
  SELECT *, level = 0 AND coalesce(lead(level) OVER (PARTITION BY mid ORDER BY line) > 0, false) AND regexp_matches(raw, '(?i)\b(wrote|writes|said|schrieb|a écrit|écrit|escribió)\s*:\s*$') AS announces
  FROM lines
), bare AS (
  SELECT b.mid, b.conv_id, b.turn, b.role, CASE WHEN q.mid IS NULL THEN b.text ELSE regexp_replace(coalesce(o.own, ''), '^\s+|\s+$', '', 'g') END AS text
  FROM base b LEFT JOIN (SELECT DISTINCT mid FROM lines) q ON b.mid = q.mid
  LEFT JOIN (SELECT mid, string_agg(raw, chr(10) ORDER BY line) AS own FROM told WHERE level = 0 AND NOT announces GROUP BY mid) o ON b.mid = o.mid
), runs AS (
  SELECT l.mid, v.depth, l.line, l.level, l.body, sum(CASE WHEN l.level < v.depth THEN 1 ELSE 0 END) OVER (PARTITION BY l.mid, v.depth ORDER BY l.line) AS run
  FROM lines l JOIN (SELECT DISTINCT mid, level AS depth FROM lines WHERE level > 0) v ON l.mid = v.mid
), passages AS (
  SELECT mid, depth, min(line) AS line, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY line)), '[^\p{L}\p{N}]+', ' ', 'g')) AS words
  FROM runs WHERE level = depth GROUP BY mid, depth, run
), parts AS (
  SELECT mid, conv_id, turn, 0 AS kind, text AS part FROM bare
  UNION ALL SELECT mid, conv_id, turn, 1, unnest(string_split_regex(text, '\n\s*\n')) FROM bare
  UNION ALL SELECT mid, conv_id, turn, 2, unnest(string_split_regex(text, '\n')) FROM bare
), offered AS (
  SELECT mid, conv_id, turn, kind, trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM parts WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), near AS (
  SELECT words, conv_id, min((turn, kind, mid)) AS nearest FROM offered WHERE words IN (SELECT words FROM passages WHERE words <> '') GROUP BY words, conv_id
), far AS (
  SELECT words, min((conv_id, nearest[1], nearest[3])) AS farthest FROM near GROUP BY words
), linked AS (
  SELECT p.mid, p.depth, p.line, CASE WHEN n.nearest[1] < b.turn THEN n.nearest[3] WHEN (f.farthest[1], f.farthest[2]) < (b.conv_id, b.turn) THEN f.farthest[3] END AS original
  FROM passages p JOIN bare b ON p.mid = b.mid LEFT JOIN near n ON p.words = n.words AND b.conv_id = n.conv_id LEFT JOIN far f ON p.words = f.words
  WHERE p.words <> ''
), parent AS (
  SELECT mid, arg_min(original, line) AS parent FROM linked WHERE depth = 1 AND original IS NOT NULL AND original <> mid GROUP BY mid
), up AS (
  SELECT b.mid, b.mid AS root, CAST(0 AS BIGINT) AS depth FROM bare b LEFT JOIN parent p ON b.mid = p.mid WHERE p.mid IS NULL
  UNION ALL SELECT p.mid, u.root, u.depth + 1 FROM parent p JOIN up u ON p.parent = u.mid
)
SELECT b.conv_id, b.turn, b.role, b.text, CAST(coalesce(q.n, 0) AS BIGINT) AS n_quotes, CAST(coalesce(q.deep, 0) AS BIGINT) AS quote_levels, CAST(coalesce(h.n, 0) AS BIGINT) AS n_linked,
       a.conv_id AS reply_conv, a.turn AS reply_turn, r.conv_id AS conversation, r.turn AS conversation_turn, u.depth
FROM bare b JOIN up u ON b.mid = u.mid JOIN bare r ON u.root = r.mid LEFT JOIN parent p ON b.mid = p.mid LEFT JOIN bare a ON p.parent = a.mid
LEFT JOIN (SELECT mid, count(*) AS n, max(depth) AS deep FROM passages GROUP BY mid) q ON b.mid = q.mid
LEFT JOIN (SELECT mid, count(*) AS n FROM linked WHERE original IS NOT NULL AND original <> mid GROUP BY mid) h ON b.mid = h.mid
"""

#: Conversations whose messages quote, in SQL that Spark and DuckDB both run: each odd turn quotes the message before it, each
#: second of the others quotes that one with its quotation.
QUOTED = """
SELECT conv_id, turn, role,
       CASE WHEN turn % 2 = 1 AND one IS NOT NULL THEN concat('> ', replace(one, chr(10), concat(chr(10), '> ')), chr(10), own)
            WHEN turn % 4 = 2 AND two IS NOT NULL
            THEN concat('> ', replace(concat('> ', replace(two, chr(10), concat(chr(10), '> ')), chr(10), one), chr(10), concat(chr(10), '> ')), chr(10), own)
            ELSE own END AS text
FROM (
  SELECT conv_id, turn, role, coalesce(text, '') AS own, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS one,
         lag(coalesce(text, ''), 2) OVER (PARTITION BY conv_id ORDER BY turn) AS two
  FROM {conversations}
) AS c"""
QUOTED_SQL = QUOTES_SQL.replace("WITH RECURSIVE", f"WITH RECURSIVE quoted AS ({QUOTED.format(conversations='conversations')}),").replace("coalesce(text, '') AS text FROM conversations", "coalesce(text, '') AS text FROM quoted")
