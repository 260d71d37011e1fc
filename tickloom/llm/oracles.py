"""DuckDB twins of the queries that SQL can express, over whole tables.

The others (a tokenizer vocabulary, XXH64 fingerprints, MinHash lines, trained models, keyed
surrogates) are tested against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_decontamination"] = r"""
WITH w AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
s AS (SELECT kind, r, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM w),
p AS (SELECT kind, r, id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS a FROM s WHERE len(words) > 0),
i AS (SELECT DISTINCT CAST(id AS VARCHAR) AS item, list_slice(words, a, a + 9) AS win FROM p WHERE kind = 'i'),
n AS (SELECT DISTINCT len(win) AS n FROM i),
o AS (SELECT s.r, q.a, list_slice(s.words, q.a, q.a + q.n - 1) AS win, q.n
      FROM s, LATERAL (SELECT n.n, unnest(range(1, len(s.words) - n.n + 2)) AS a FROM n WHERE n.n <= len(s.words)) q WHERE s.kind = 'd'),
h AS (SELECT o.r, o.a, o.n, i.item FROM o JOIN i ON i.win = o.win),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS k FROM h) x GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) x GROUP BY r)
SELECT s.id AS doc_id, CAST(len(s.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM s LEFT JOIN c ON c.r = s.r LEFT JOIN t ON t.r = s.r WHERE s.kind = 'd'
"""

ORACLES["op6_embeddings"] = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b, a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS start, b AS node FROM l UNION SELECT reach.start, l.b FROM reach JOIN l ON l.a = reach.node),
c AS (SELECT reach.start, min(v.vec_id) AS low FROM reach JOIN v ON v.r = reach.node GROUP BY reach.start),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, c.low) AS component_id, coalesce(v.vec_id = least(v.vec_id, c.low), true) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN c ON c.start = v.r
"""

# The template is restated to count formatted characters.
ORACLES["op7_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss,
    sum(length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'))
      + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 15)::BIGINT AS chars
  FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  chars AS formatted_chars FROM g
"""

ORACLES["op10_substring"] = r"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS a FROM s WHERE len(words) >= 50 AND doc_id IS NOT NULL),
h AS (SELECT r, doc_id, a, md5(array_to_string(list_slice(words, a, a + 49), ' ')) AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)),
k AS (SELECT DISTINCT h.r, unnest(range(h.a, h.a + 50)) AS pos FROM h JOIN f ON f.win = h.win AND f.first < h.doc_id),
g AS (SELECT r, count(*) AS n, list(pos) AS gone FROM k GROUP BY r)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g.r IS NULL THEN s.words ELSE list_filter(s.words, lambda x, i: NOT list_contains(g.gone, i)) END, ' ')) AS kept_sha256
FROM s LEFT JOIN g ON g.r = s.r
"""

# CRC-32 over the bytes of `conv_id:turn`, then the cheapest audits row by row.
ORACLES["op11_repair"] = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))),
    CAST(4294967295 AS BIGINT)) % 20 AS kind FROM c),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
f AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM o),
e AS (SELECT * FROM (VALUES (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
  (0, 2, 'R', 3, ''), (1, 2, 'R', 3, ''), (3, 2, 'R', 3, ''), (2, 3, 'R', 3, ''),
  (0, 0, 'D', 4, ''), (1, 1, 'D', 4, ''), (2, 2, 'D', 4, ''), (3, 3, 'D', 4, '')) v(src, dst, letter, price, needs)),
b AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, s AS state, p AS cost, a AS audit
  FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0, 0, ''), (2, 3, 'I'), (3, 6, 'II')) v(s, p, a)
  UNION ALL
  SELECT conv_id, pos, state, cost, audit FROM (
    SELECT x.conv_id, x.pos, CASE i WHEN 0 THEN x.dst WHEN 1 THEN CASE x.dst WHEN 2 THEN 3 ELSE 2 END ELSE CASE x.dst WHEN 2 THEN 2 ELSE 3 END END AS state,
      x.cost + 3 * i AS cost, x.audit || repeat('I', i) AS audit
    FROM (SELECT b.conv_id, f.pos, e.dst, b.cost + e.price + CASE WHEN f.fault = 3 AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost, b.audit || e.letter AS audit
          FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos + 1
          JOIN e ON e.src = b.state AND (e.letter = 'D' OR f.fault NOT IN (1, 2)) AND (e.needs = '' OR e.needs = f.ini)) x,
      (VALUES (0), (1), (2)) n(i)) y
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
z AS (
  SELECT conv_id, cost, audit FROM (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS top FROM b) WHERE pos = top AND state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
l AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS step FROM z),
m AS (
  SELECT conv_id, step, audit[step] AS letter, count(*) FILTER (audit[step] <> 'I') OVER w AS pos,
    count(*) FILTER (audit[step] <> 'D') OVER w AS outs FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
r AS (
  SELECT m.*, f.role, f.text, first_value(CASE WHEN m.letter = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id ORDER BY m.step) AS sys
  FROM m LEFT JOIN f ON m.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos WHERE m.letter <> 'D'),
t AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (outs - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY step) AS said FROM r GROUP BY conv_id),
q AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM f) GROUP BY conv_id)
SELECT z.conv_id, coalesce(q.gaps, 0) AS gaps, coalesce(q.blank, 0) AS blank, coalesce(q.duplicate, 0) AS duplicate,
  coalesce(q.truncated, 0) AS truncated, coalesce(q.illegal, 0) AS illegal, CAST(z.cost AS BIGINT) AS cost, z.audit,
  sha256(coalesce(t.said, '')) AS repaired_sha256
FROM z LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM z.conv_id
"""

ORACLES["op12_topk_vectors"] = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM v
       WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM ok q JOIN ok c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) t WHERE rank <= 5
"""

ORACLES["op13_lexical"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
i AS (
  SELECT row_number() OVER () AS r, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
n AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0),
q AS (SELECT r, item_id, term, count(*) AS times FROM (SELECT r, item_id, unnest(words) AS term FROM i) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n.docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, n GROUP BY term, n.docs),
p AS (SELECT t.r, t.term, w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (100 - 25 + ((25 * len(d.words) * n.docs) // n.total)))) AS impact
      FROM t JOIN d ON d.r = t.r JOIN w ON w.term = t.term, n),
s AS (SELECT q.r, q.item_id, d.r AS dr, d.doc_id, CAST(sum(q.times * p.impact) AS BIGINT) AS score FROM q JOIN p ON p.term = q.term JOIN d ON d.r = p.r
      GROUP BY ALL HAVING sum(q.times * p.impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) x WHERE rank <= 20
"""
