"""Query of substring deduplication over all documents, with its SQL twin."""

from pyspark.sql import functions as F

from flowguard.llm.common import table
from flowguard.llm.registry import query
from flowguard.llm.substring_dedup import remove_repeats

SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM d, range(1, len(w) - 18) AS r(i)),
f AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM f, range(20) AS r(k)),
x AS (SELECT d.doc_id, r.i, w[r.i] AS word, gone.i IS NULL AS stays
  FROM d, range(1, len(w) + 1) AS r(i) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.i = r.i),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT stays) AS r,
  coalesce(string_agg(word, ' ' ORDER BY i) FILTER (stays), '') AS kept FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""


@query("op4_substring_dedup", SQL)
def op4(spark, sf):
    return remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
