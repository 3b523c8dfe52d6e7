"""DuckDB's form of the line-first quality rules."""

from millrace.llm.quality_rules import KEEP, LEAST_WORDS, MENU, NOTICE, NOTICE_CHARS

_Q = lambda s: s.replace("'", "''")
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_MARK = "[#*$%&|<>]"

ORACLE = f"""
WITH src AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), base AS (
  SELECT rid, doc_id, t, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM src
), win AS (
  SELECT rid, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM base
), shingle AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM win
), twins AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM shingle) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twins) GROUP BY rid
), line AS (
  SELECT rid, unnest(list_distinct(lines)) AS x FROM base
), measured AS (
  SELECT rid, x, {_WORDS.format("x")} AS lw, regexp_split_to_array(x, '\\s[|»>·]\\s?') AS items FROM line
), good AS (
  SELECT rid, sum(len(lw)) AS n FROM measured
  WHERE NOT (
    (regexp_matches(x, '[#*$%&|<>»·]') AND ((len(lw) >= 5 AND 2 * len(list_filter(lw, lambda y: regexp_matches(y, '{_MARK}'))) >= len(lw)) OR (len(items) >= 3 AND len(lw) < 8 * len(items))))
    OR (length(x) <= {NOTICE_CHARS} AND (regexp_matches(x, '{_Q(MENU)}') OR regexp_matches(x, '{_Q(NOTICE)}'))))
  GROUP BY rid
), figures AS (
  SELECT base.rid, doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '{_MARK}', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(good.n, 0) AS left_words
  FROM base LEFT JOIN covered USING (rid) LEFT JOIN good USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND left_words >= {KEEP} * n_words) AS kept
FROM figures
"""
