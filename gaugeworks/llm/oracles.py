"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_chat_format"] = r"""
WITH x AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), y AS (
  SELECT *, regexp_matches(text, '<s>|</s>|\[/?INST\]|<</?SYS>>|<\||[<\[]\\|\\\\') AS esc,
         length(text) - length(regexp_replace(text, '[<\[\\]', '', 'g')) AS marks,
         length(role) - length(regexp_replace(role, '[<\[\]\\]', '', 'g')) AS role_marks
  FROM x
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(11 + length(role) + role_marks + length(text) + CASE WHEN esc THEN marks ELSE 0 END) AS BIGINT) AS formatted_chars,
       CAST(sum(CAST(esc AS INT)) AS BIGINT) AS n_escaped
FROM y GROUP BY conv_id
"""

ORACLE_SQL["op8_host_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, i, list_slice(words, i, i + 4) AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM d)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, i + unnest(range(0, 5)) AS w FROM dup) GROUP BY rid
), m AS (
  SELECT d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS docs, sum(CAST(base_failed OR 20 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines AS INT)) AS fails FROM f GROUP BY source
), p AS (
  SELECT avg(fails / docs) AS m, greatest(var_pop(fails / docs), 1e-6) AS v FROM h
), s AS (
  SELECT m, least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) AS k FROM p
), r AS (
  SELECT source, (fails + m * k) / (docs + k) AS rate FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND rate <= greatest(0.3, least(0.5, m + 3 * sqrt(m * (1 - m) / (k + 1)))) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source, s
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL["op10_decontamination"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item, size, list_slice(words, i, i + size - 1) AS gram
  FROM (SELECT item, words, least(13, len(words)) AS size, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), dw AS (
  SELECT rid, i, size, list_slice(words, i, i + size - 1) AS gram
  FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))
), hit AS (
  SELECT rid, i, bw.size AS size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram
), n AS (
  SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, i + unnest(range(0, size)) AS w FROM hit) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""

ORACLE_SQL["op12_funnels"] = r"""
WITH c AS (
  SELECT DISTINCT client_id, kind, epoch_us(ts) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL
), f(funnel, k1, k2, k3, k4, ex) AS (
  VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')
), s1 AS (
  SELECT funnel, client_id, t AS t1, k2, k3, k4, ex FROM f JOIN c ON kind = k1
), a2 AS (
  SELECT s1.*, c.t AS n2 FROM s1 ASOF LEFT JOIN c ON s1.client_id = c.client_id AND s1.k2 = c.kind AND s1.t1 < c.t
), b2 AS (
  SELECT a2.*, c.t AS e2 FROM a2 ASOF LEFT JOIN c ON a2.client_id = c.client_id AND a2.ex = c.kind AND a2.t1 < c.t
), s2 AS (
  SELECT funnel, client_id, k3, k4, ex, t1, CASE WHEN n2 - t1 <= 900000000 AND (e2 IS NULL OR e2 > n2) THEN n2 END AS t2 FROM b2
), a3 AS (
  SELECT s2.*, c.t AS n3 FROM s2 ASOF LEFT JOIN c ON s2.client_id = c.client_id AND s2.k3 = c.kind AND s2.t2 < c.t
), b3 AS (
  SELECT a3.*, c.t AS e3 FROM a3 ASOF LEFT JOIN c ON a3.client_id = c.client_id AND a3.ex = c.kind AND a3.t2 < c.t
), s3 AS (
  SELECT funnel, client_id, k4, ex, t1, t2, CASE WHEN n3 - t2 <= 900000000 AND (e3 IS NULL OR e3 > n3) THEN n3 END AS t3 FROM b3
), a4 AS (
  SELECT s3.*, c.t AS n4 FROM s3 ASOF LEFT JOIN c ON s3.client_id = c.client_id AND s3.k4 = c.kind AND s3.t3 < c.t
), b4 AS (
  SELECT a4.*, c.t AS e4 FROM a4 ASOF LEFT JOIN c ON a4.client_id = c.client_id AND a4.ex = c.kind AND a4.t3 < c.t
), s4 AS (
  SELECT funnel, client_id, t1, t2, t3, CASE WHEN n4 - t3 <= 900000000 AND (e4 IS NULL OR e4 > n4) THEN n4 END AS t4 FROM b4
), g AS (
  SELECT funnel, client_id, count(*) AS n1, count(t2) AS n2, count(t3) AS n3, count(t4) AS n4,
         list_sort(list(t2 - t1) FILTER (WHERE t2 IS NOT NULL)) AS d2, list_sort(list(t3 - t2) FILTER (WHERE t3 IS NOT NULL)) AS d3, list_sort(list(t4 - t3) FILTER (WHERE t4 IS NOT NULL)) AS d4
  FROM s4 GROUP BY funnel, client_id
), h AS (
  SELECT *, CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS deepest FROM g
)
SELECT funnel, client_id, n1, n2, n3, n4, CAST(deepest AS INTEGER) AS deepest, d2[(n2 + 1) // 2] AS t2, d3[(n3 + 1) // 2] AS t3, d4[(n4 + 1) // 2] AS t4,
       count(*) OVER (PARTITION BY funnel, deepest) AS same_depth
FROM h
"""

ORACLE_SQL["op13_filter_audit"] = r"""
WITH x AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), y AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM x
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT rid, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(y.doc_id > least, false)} AS fails
  FROM y LEFT JOIN l ON y.doc_id = l.doc_id
), u AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM u a, u b, u c, u d, u e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[:step - 1] AS before, replace('ABCDE', filter_order[step], '') AS others FROM o, (SELECT unnest(range(1, 6)) AS step)
), v AS (
  SELECT rid, part, good, toxic, array_to_string(list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f WHEN 'A' THEN fails['A'] WHEN 'B' THEN fails['B'] WHEN 'C' THEN fails['C'] WHEN 'D' THEN fails['D'] ELSE fails['E'] END), '') AS failed
  FROM d
), w AS (
  SELECT part, filter_order, step, f, good, toxic, failed = f AS alone, contains(failed, f) AS now, regexp_matches(failed, '[' || before || '_]') AS earlier FROM v, s
), g AS (
  SELECT part, filter_order, step, f, count(*) FILTER (WHERE NOT earlier AND NOT now) AS kept, count(*) FILTER (WHERE now AND NOT earlier) AS removed, count(*) FILTER (WHERE now AND earlier) AS redundant,
         count(*) FILTER (WHERE alone) AS unique_fails, count(*) FILTER (WHERE now AND NOT earlier AND good = 1) AS good_lost, count(*) FILTER (WHERE now AND NOT earlier AND toxic = 1) AS toxic_lost
  FROM w GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""
