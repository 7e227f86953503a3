"""Query of near-duplicate grouping over all documents, with its SQL twin."""

from flowguard.llm.common import table
from flowguard.llm.near_dedup import near_duplicates
from flowguard.llm.registry import query

SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN hash(w[1]) ELSE hash(w[i], w[i + 1]) END AS h
  FROM d, range(1, greatest(len(w), 2)) AS r(i) WHERE len(w) > 0 AND i < greatest(len(w), 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b USING (h)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id
  WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a AS doc_id, b AS other FROM e UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(c.m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


@query("op9_near_duplicates", SQL)
def op9(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), n=2, percent=80)
