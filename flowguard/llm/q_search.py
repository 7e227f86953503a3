"""Query of ranked search for every benchmark item, with its SQL twin."""

from flowguard.llm.common import table
from flowguard.llm.lexical_search import search
from flowguard.llm.registry import query

TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
         r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SQL = f"""
WITH q AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark)
  GROUP BY ALL),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(qn * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))
  ::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20"""


@query("op12_lexical_search", SQL)
def op12(spark, sf):
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
