"""DuckDB statements for the queries of this subpackage that SQL can express."""

ORACLES = {
    "op1_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    length(regexp_replace(text, '<(!*)\|', '<!\1|', 'g')) AS text_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN k > 1 AND before = role THEN length('<|im_next|>')
    ELSE length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op5_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
q AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1),
x AS (SELECT r, count(DISTINCT i + k) AS n FROM q, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT r, doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words
  FROM w LEFT JOIN x USING (r)),
b AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive FROM m),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (short) AS f1, count(*) FILTER (repetitive) AS f2 FROM b GROUP BY source),
a AS (
  SELECT sum(f1) / sum(n) AS m1, sum(f2) / sum(n) AS m2,
    sum(f1 * f1 / n) / sum(n) - (sum(f1) / sum(n)) * (sum(f1) / sum(n)) AS v1,
    sum(f2 * f2 / n) / sum(n) - (sum(f2) / sum(n)) * (sum(f2) / sum(n)) AS v2 FROM h),
s AS (
  SELECT source,
    CASE WHEN v1 <= 1e-12 THEN m1 ELSE (f1 + m1 * greatest(m1 * (1 - m1) / v1 - 1, 0))
      / (n + greatest(m1 * (1 - m1) / v1 - 1, 0)) END AS r1,
    CASE WHEN v2 <= 1e-12 THEN m2 ELSE (f2 + m2 * greatest(m2 * (1 - m2) / v2 - 1, 0))
      / (n + greatest(m2 * (1 - m2) / v2 - 1, 0)) END AS r2 FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND greatest(r1, r2) <= 0.8 AS kept
FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
x AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT o.lang, o.source, coalesce(s.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) o
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
w AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM w)
WHERE part = 'pair' OR rank <= 200""",
    "op13_periodic_runs": r"""
WITH z AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS b,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
c AS (
  SELECT r, doc_id, words, len(words) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295::BIGINT, list_reduce(
    list_transform(range(8 * length(b)), lambda k: CASE WHEN k % 8 = 0 THEN ord(b[k // 8 + 1])::BIGINT ELSE 0::BIGINT END),
    lambda s, y: CASE WHEN xor(s, y) % 2 = 1 THEN xor(xor(s, y) // 2, 3988292384::BIGINT) ELSE xor(s, y) // 2 END,
    4294967295::BIGINT)) END AS h FROM z),
a AS (
  SELECT r, doc_id, n, words, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, h // 10 AS g FROM c),
w AS (
  SELECT r, n, i, CASE WHEN planted AND i >= a THEN words[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] ELSE words[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM a)),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island
  HAVING count(*) + q >= greatest(24, 3 * q)),
u AS (SELECT r, start, length, min(q) AS q FROM s GROUP BY r, start, length),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / q DESC, start, q) = 1),
t AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM u GROUP BY r),
k AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM w
  WHERE NOT EXISTS (FROM u WHERE u.r = w.r AND w.i >= u.start + u.q AND w.i < u.start + u.length) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM a LEFT JOIN t USING (r) LEFT JOIN b USING (r) LEFT JOIN k USING (r)""",
}
