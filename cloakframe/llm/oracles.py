"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

ORACLES = {
    "op8_decontaminate": r"""
WITH tokens AS (
  SELECT doc_id, n AS pos, w FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM (
      SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM documents))
), items AS (
  SELECT item_id, ws, least(10, len(ws)) AS size FROM (
    SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS span
  FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM items)
), lengths AS (SELECT DISTINCT size FROM windows),
texts AS (
  SELECT doc_id, list(w ORDER BY pos) AS ws FROM tokens GROUP BY doc_id
), spans AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS span
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM texts, lengths WHERE len(ws) >= size)
), hits AS (
  SELECT s.doc_id, s.i, s.size, w.item_id FROM spans s JOIN windows w USING (size, span)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(t.ws), 0)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
  coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.x, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
""",
    "op6_mixing": r"""
WITH RECURSIVE held AS (
  SELECT source, sum(coalesce(length(text), 0) + 1)::BIGINT AS chars FROM documents GROUP BY source
), rates AS (
  SELECT source, pow(chars, 0.5) / (SELECT sum(pow(chars, 0.5)) FROM held) * (SELECT sum(chars)::BIGINT FROM held) / chars AS rate FROM held
), parts AS (
  SELECT source, greatest(ceil(rate / 16), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 16), 1) AS mean FROM rates
), steps AS (
  SELECT source, mean, parts, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
  UNION ALL
  SELECT source, mean, parts, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k < 96
), named AS (
  SELECT d.*, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents d
), draws AS (
  SELECT n.*, unnest(range(0, p.parts)) AS part FROM named n JOIN parts p ON n.source IS NOT DISTINCT FROM p.source
), uniform AS (
  SELECT *, CAST(('0x' || substr(md5('2024|' || name || '|' || part), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM draws
), drawn AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.name, u.part, count(s.c) AS n
  FROM uniform u LEFT JOIN steps s ON u.source IS NOT DISTINCT FROM s.source AND u.u >= s.c GROUP BY ALL
), counted AS (
  SELECT doc_id, text, lang, source, n_chars, name, sum(n)::BIGINT AS n FROM drawn GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no, substr(md5('order|2024|' || name || '|' || copy_no), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(0, n)) AS copy_no FROM counted WHERE n > 0)
""",
    "op11_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5
), judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
""",
    "op12_merkle": r"""
WITH RECURSIVE bits AS (
  SELECT unnest(range(0, 256))::BIGINT AS i, 0 AS k, unnest(range(0, 256))::BIGINT AS v
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS crcs FROM bits WHERE k = 8
), given AS (
  SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents d, crc_table
), parts AS (
  SELECT doc_id, source, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM given
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS claimed FROM parts
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS r FROM hashed
), tree AS (
  SELECT 0 AS lvl, source, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS total FROM leaves
  UNION ALL
  SELECT lvl + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max((total + 2) // 3) FROM tree WHERE total > 1 GROUP BY lvl, source, pos // 3
), tops AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE total = 1
), crown AS (
  SELECT 0 AS lvl, pos, subroot AS digest, count(*) OVER () AS total FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max((total + 2) // 3) FROM crown WHERE total > 1 GROUP BY lvl, pos // 3
), runs AS (
  SELECT l.r, 0 AS part, t.lvl, t.pos, l.pos // CAST(pow(3, t.lvl) AS BIGINT) AS own, t.digest
  FROM leaves l JOIN tree t ON l.source IS NOT DISTINCT FROM t.source AND t.total > 1 AND t.pos // 3 = l.pos // CAST(pow(3, t.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT l.r, 1, c.lvl, c.pos, p.pos // CAST(pow(3, c.lvl) AS BIGINT), c.digest
  FROM leaves l JOIN tops p ON l.source IS NOT DISTINCT FROM p.source JOIN crown c ON c.total > 1 AND c.pos // 3 = p.pos // CAST(pow(3, c.lvl + 1) AS BIGINT)
), proofs AS (
  SELECT r, string_agg(digest, '' ORDER BY part, lvl, pos) AS proof FROM runs WHERE pos <> own GROUP BY r
), steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY part, lvl) AS step, lefts, rights FROM (
    SELECT r, part, lvl, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS lefts,
      coalesce(string_agg(digest, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS rights FROM runs GROUP BY r, part, lvl)
), folded AS (
  SELECT r, 0::BIGINT AS step, claimed AS digest FROM leaves
  UNION ALL
  SELECT f.r, s.step, sha256(s.lefts || f.digest || s.rights) FROM folded f JOIN steps s ON f.r = s.r AND s.step = f.step + 1
), ends AS (SELECT r, arg_max(digest, step) AS folded_root FROM folded GROUP BY r)
SELECT l.doc_id, l.leaf, p.subroot, c.digest AS root, sha256(coalesce(s.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = c.digest AS verified
FROM leaves l JOIN tops p ON l.source IS NOT DISTINCT FROM p.source JOIN crown c ON c.total = 1
JOIN ends e ON l.r = e.r LEFT JOIN proofs s ON l.r = s.r
""",
    "op13_filter_audit": r"""
WITH known AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), flags AS (
  SELECT doc_id, part, list_filter([
    CASE WHEN len(ws) < 100 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM texts
), counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM flags LEFT JOIN known USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, step, o[step] AS f, o[1:step - 1] AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders)
), sums AS (
  SELECT part, o, step, f,
    coalesce(sum(n) FILTER (WHERE NOT list_has_any(fails, before) AND NOT list_contains(fails, f)), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE NOT list_has_any(fails, before) AND list_contains(fails, f)), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE list_has_any(fails, before) AND list_contains(fails, f)), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = [f]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT list_has_any(fails, before) AND list_contains(fails, f)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT list_has_any(fails, before) AND list_contains(fails, f)), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step, f
)
SELECT part, array_to_string(o, '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
""",
}
