"""Plain SQL of the operators that SQL can express."""

from __future__ import annotations

#: Rows numbered, since a doc_id may repeat.
_DOCS = "docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"

WORDS_50 = f"""
WITH {_DOCS},
d AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (SELECT rid, doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(s, s + 50)) AS p FROM windows JOIN firsts USING (k) WHERE first < doc_id) GROUP BY rid),
kept AS (SELECT d.rid, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(x.p) AS n FROM d LEFT JOIN gone USING (rid), LATERAL (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p) x WHERE NOT coalesce(list_contains(ps, x.p), false) GROUP BY d.rid)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

LEAKS = f"""
WITH {_DOCS},
d AS (SELECT rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM docs),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
theirs AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
ours AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM theirs) WHERE len(w) >= n)),
hits AS (SELECT rid, s, n, item FROM ours JOIN theirs USING (k, n)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

BYTES_50 = f"""
WITH {_DOCS},
d AS (SELECT rid, doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM docs),
windows AS (SELECT rid, doc_id, s, md5(substring(h, 2 * s - 1, 100)) AS k FROM (SELECT rid, doc_id, h, unnest(range(1, n - 48)) AS s FROM d WHERE n >= 50)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
hits AS (SELECT rid, s, max(s + 50) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM windows JOIN firsts USING (k) WHERE first < doc_id),
runs AS (SELECT rid, s, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS run FROM hits),
spans AS (SELECT rid, run, min(s) AS a, max(s) + 50 AS e FROM runs GROUP BY rid, run),
edges AS (SELECT rid, a, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 1) AS from_ FROM spans),
parts AS (SELECT d.rid, string_agg(substring(h, 2 * from_ - 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(e) AS tail, sum(e - a) AS gone, count(*) AS n_spans FROM edges JOIN d USING (rid) GROUP BY d.rid)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(tail, 1) - 1))) AS kept_sha256 FROM d LEFT JOIN parts USING (rid)
"""

_MARKS = "'^[ \\t]*(?:>[ \\t]*)+'"
_QUOTED = "array_to_string(list_transform(string_split({0}.text, chr(10)), lambda x: '{1} ' || x), chr(10)) || chr(10)"
THREADS = f"""
WITH RECURSIVE plain AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY 1, 2),
messages AS (
  SELECT row_number() OVER () AS rid, c.conv_id, c.turn, c.role,
    CASE WHEN c.turn % 4 = 3 THEN coalesce({_QUOTED.format('g', '>>')}, '') ELSE '' END
    || CASE WHEN c.turn % 4 <> 0 THEN coalesce({_QUOTED.format('p', '>')}, '') ELSE '' END || coalesce(c.text, '') AS text
  FROM conversations c LEFT JOIN plain p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN plain g ON g.conv_id = c.conv_id AND g.turn = c.turn - 2),
split AS (SELECT rid, conv_id, turn, x.raw, x.i FROM (SELECT *, string_split_regex(text, '\\r?\\n') AS w FROM messages), LATERAL (SELECT unnest(w) AS raw, unnest(range(len(w))) AS i) x),
lines AS (SELECT *, length(regexp_replace(regexp_extract(raw, {_MARKS}), '[^>]', '', 'g')) AS depth, trim(regexp_replace(lower(regexp_replace(raw, {_MARKS}, '')), '\\s+', ' ', 'g')) AS norm FROM split),
first_ AS (SELECT conv_id, norm, min(turn) AS source FROM lines WHERE depth = 0 AND norm <> '' GROUP BY 1, 2),
votes AS (SELECT l.conv_id, l.turn, l.depth, f.source, count(*) AS n FROM lines l JOIN first_ f ON f.conv_id = l.conv_id AND f.norm = l.norm WHERE l.depth > 0 AND f.source < l.turn GROUP BY 1, 2, 3, 4),
parents AS (SELECT conv_id, turn, source AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth, n DESC, source DESC) AS r FROM votes) WHERE r = 1),
tree AS (SELECT conv_id, turn, reply_to AS up, 1 AS depth FROM parents UNION ALL SELECT t.conv_id, t.turn, p.reply_to, t.depth + 1 FROM tree t JOIN parents p ON p.conv_id = t.conv_id AND p.turn = t.up),
tops AS (SELECT conv_id, turn, arg_max(up, depth) AS thread, max(depth) AS depth FROM tree GROUP BY 1, 2),
bodies AS (SELECT rid, trim(coalesce(string_agg(CASE WHEN depth = 0 THEN raw END, chr(10) ORDER BY i), '')) AS text, count(*) FILTER (depth > 0) AS n_quoted, max(depth) AS max_level FROM lines GROUP BY 1)
SELECT m.conv_id, m.turn, m.role, b.text, b.n_quoted, b.max_level, CAST(p.reply_to AS BIGINT) AS reply_to, CAST(CASE WHEN m.conv_id IS NOT NULL THEN coalesce(t.thread, m.turn) END AS BIGINT) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth
FROM messages m JOIN bodies b USING (rid) LEFT JOIN parents p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN tops t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""

ORACLE = {"op1_substring_dedup": WORDS_50, "op2_decontaminate": LEAKS, "op4_suffix_dedup": BYTES_50, "op6_quotation_linking": THREADS}
