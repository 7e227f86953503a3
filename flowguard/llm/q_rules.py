"""Query of the rule ledger over all documents, with its SQL twin."""

from pyspark.sql import functions as F

from flowguard.llm import quality_rules as R
from flowguard.llm.common import table
from flowguard.llm.registry import query

BASE = R.bits(R.POLICIES["1"])


def _sql() -> str:
    failed = " OR ".join(f"({r.fails})" for r in R.RULES if r.name in R.POLICIES[R.CURRENT])
    marks = "length(t) - length(translate(t, '{0}', ''))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, hash(words[i], words[i+1], words[i+2], words[i+3], words[i+4]) AS h
  FROM w, range(1, len(words) - 3) AS s(i)),
f AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
c AS (SELECT r, sum(least(5, coalesce(n - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM f) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  ({marks.format(R.SYMBOLS)})::BIGINT AS n_symbols, ({marks.format('!?')})::BIGINT AS n_marks,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, NOT ({failed}) AS kept
FROM m"""


@query("op10_rule_ledger", _sql())
def op10(spark, sf):
    rows = R.apply_policy(R.ledger(table(spark, sf, "documents")), R.POLICIES[R.CURRENT])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words",
                       (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
                       "kept")
