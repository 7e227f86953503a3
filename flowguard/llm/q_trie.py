"""Query of the prefix trie over all conversations, with its SQL twin."""

from flowguard.llm.common import table
from flowguard.llm.prefix_trie import prefix_trie, with_shared_heads
from flowguard.llm.registry import query

# crc32 of the decimal id: a list of its bytes, each followed by eight shifts (-1).
CRC = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform("
       "string_split(conv_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), "
       "lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END))")
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT *, {CRC} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
m AS (SELECT c.conv_id, 0 AS part, b.i, b.role, b.text FROM c JOIN t AS b ON b.conv_id = c.base AND b.i < h
  UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= h),
r AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size, list(struct_pack(role, text)) OVER w AS prefix
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
l AS (SELECT c.conv_id, coalesce(max(depth), 0) AS len FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, depth, size, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, min(conv_id) OVER () FROM l),
n AS (SELECT node, depth, count(*) AS n_convs, max(size) AS size, max(len) AS longest,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY node, depth),
u AS (SELECT n.node, n.depth, up.node AS parent FROM n JOIN p AS up ON up.conv_id = n.node AND up.depth = n.depth - 1),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM u GROUP BY ALL),
s AS (SELECT up.node, up.depth, sum((longest = n.depth)::INT)::BIGINT AS n_leaves,
  sum(CASE WHEN n.depth > 0 THEN (n_convs - 1) * n.size ELSE 0 END)::BIGINT AS saved_tokens
  FROM n JOIN p AS up ON up.conv_id = n.node AND up.depth <= n.depth GROUP BY ALL)
SELECT n.node AS conv_id, n.depth::BIGINT AS depth, u.parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, ends_sha256
FROM n JOIN s USING (node, depth) LEFT JOIN u USING (node, depth) LEFT JOIN k USING (node, depth)"""


@query("op13_prefix_trie", SQL)
def op13(spark, sf):
    return prefix_trie(table(spark, sf, "conversations"), with_shared_heads)
