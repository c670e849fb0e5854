"""DuckDB SQL for the operators that SQL can express.

Fixed values are written out here, not imported from the operators.
"""

from __future__ import annotations

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d
), p AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), tri AS (
  SELECT rid, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
  FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)
), rep AS (
  SELECT rid, i FROM (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n >= 2
), cov AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, len(ws) AS n_words,
    length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '!')) AS n_excl,
    len(list_filter(ws, lambda x: lower(x) IN (
      'the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'for', 'it', 'was', 'on', 'with', 'be', 'are', 'as', 'by', 'this',
      'der', 'die', 'das', 'und', 'ist', 'von', 'zu', 'den', 'im', 'nicht', 'ein', 'eine', 'mit', 'auf', 'als', 'dem', 'sich',
      'le', 'la', 'les', 'de', 'des', 'et', 'un', 'une', 'du', 'en', 'que', 'pour', 'dans', 'par', 'sur', 'qui', 'au',
      'el', 'los', 'las', 'y', 'se', 'del', 'una', 'con', 'para', 'por', 'es', 'no', 'lo', 'su'))) AS n_stop,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]') AND (ends_with(x, '...') OR ends_with(x, '…')))) AS n_ell
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  (NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 25.0 * n_words
   AND n_symbols <= 0.2 * n_words AND n_excl <= 0.5 * n_words AND n_stop >= 2
   AND n_dup_lines <= 0.5 * n_lines AND n_ell <= 0.3 * n_lines) AS kept
FROM b
"""

OP2 = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, x.vec_id,
    list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""

# size, source and target only: which documents are taken depends on a hash
OP5_TARGETS = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k
  FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][k % 3 + 1] AS weight, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, CAST(150 * sum(source_size) OVER () - 100 * coalesce(sum(cap) OVER before, 0) AS DOUBLE)
      / CAST(100 * sum(weight) OVER after AS DOUBLE) AS level
  FROM w WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY CAST(source_size AS DOUBLE) / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, source_size, CASE WHEN CAST(cap AS DOUBLE) / weight > level
      THEN max(CASE WHEN CAST(cap AS DOUBLE) / weight > level THEN level END) OVER () * weight
      ELSE CAST(cap AS DOUBLE) END AS target
  FROM l
)
SELECT doc_id, size, source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), g AS (
  SELECT rid, pos, line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key)
), r AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM g GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM r JOIN d USING (rid)
"""

# CRC-32 of each distinct word by its definition: a table of 256 remainders, folded over the bytes
OP12 = r"""
WITH RECURSIVE shifts(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifts WHERE k < 8
), remainders AS (
  SELECT list(c ORDER BY i) AS tab FROM shifts WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, 0 AS side,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT 1 AS side,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), p AS (
  SELECT rid, unnest(ws) AS word FROM d
), q AS (
  SELECT unnest(ws) AS word FROM b
), w AS (
  SELECT word, [('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT for i in range(octet_length(encode(word)))] AS bytes
  FROM (SELECT word FROM p UNION SELECT word FROM q)
), c AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes),
      lambda acc, x: xor(acc >> 8, tab[xor(acc & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM w, remainders
), s AS (
  SELECT bucket, count(*) AS s FROM p JOIN c USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM q JOIN c USING (word) GROUP BY bucket
), n AS (
  SELECT (SELECT count(*) FROM p) AS s_all, (SELECT count(*) FROM q) AS t_all
), g AS (
  SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000)
    / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS gain
  FROM s FULL JOIN t USING (bucket), n
), m AS (
  SELECT rid, count(*) AS n_features, floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS weight
  FROM p JOIN c USING (word) JOIN g USING (bucket) GROUP BY rid
), z AS (
  SELECT rid, doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN m USING (rid)
), r AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS drawn
  FROM z WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM z LEFT JOIN r USING (rid)
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (
  SELECT rid, lang, source, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), n AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang
), g AS (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(n.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (g.total + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
), pairs AS (
  SELECT lang, source, item, coalesce(value, 0) AS value
  FROM (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source)
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
  USING (lang, source, item)
), terms AS (
  SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 50
"""

LLM_ORACLES: dict[str, str] = {
    "op2_pivot_topk": OP2,
    "op9_quality_rules": OP9,
    "op11_line_dedup": OP11,
    "op12_importance_resampling": OP12,
    "op13_source_divergence": OP13,
}
