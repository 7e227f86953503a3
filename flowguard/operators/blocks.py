"""Running totals within keys whose rows span many tasks.

Rows are dealt out by ranges of (key, order) with bounds that Spark samples from the data, so a
key with a third of all rows fills a third of the blocks. Totals run inside each part of a key
that lies in one block; what the blocks before it hold is carried over. Only a key at the edge of
a block can lie in several, so there are fewer carried rows than two a block, whatever the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from flowguard.session import materialised

#: How totals of a kind are made, and how the total of two parts follows from theirs.
KINDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda a, b: a),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: b),
}


def in_blocks(df: DataFrame, keys, order, block: str = "_block") -> DataFrame:
    """The same rows, stored, with the number of the range of (keys, order) that holds them."""
    ranged = df.repartitionByRange(*keys, *order).withColumn(block, F.spark_partition_id())
    return materialised(ranged)


def _same(a: list[str], b: list[str]):
    return reduce(lambda x, y: x & y, [F.col(i).eqNullSafe(F.col(k)) for i, k in zip(a, b)])


def edge_keys(rows: DataFrame, keys, block: str = "_block") -> DataFrame:
    """Keys that lie in several blocks, as (_k0, _k1, …): fewer than there are blocks."""
    ends = rows.groupBy(block).agg(F.min(F.struct(*keys)).alias("_lo"),
                                   F.max(F.struct(*keys)).alias("_hi"))
    seam = ends.select("*", F.lag("_hi").over(W.orderBy(block)).alias("_before"))
    return (seam.where("_before IS NOT NULL AND _before <=> _lo")
            .select(*[F.col("_lo")[k].alias(f"_k{i}") for i, k in enumerate(keys)]).distinct())


def running(rows: DataFrame, keys, order, values: dict, block: str = "_block",
            backward: bool = False, exclusive: bool = False) -> DataFrame:
    """Adds, per name, the running total of a column over its key up to and including the row.

    ``rows`` come from :func:`in_blocks` with the same keys and order; ``values`` maps new names to
    (kind, column), the kinds being those of ``KINDS``. ``backward`` totals from the last row of a
    key to the first; ``exclusive`` leaves the row itself out. The order consists of names, or, forward and
    for kinds other than first and last, of any columns. Rows that tie in the order must be
    equal in all that matters, as their order among themselves is open.
    """
    names = list(values)
    key_names = [f"_k{i}" for i in range(len(keys))]

    def along(columns):
        if not backward:
            return list(columns)
        return [F.col(c).desc() for c in columns]
    inside = W.partitionBy(block, *keys).orderBy(*along(order)).rowsBetween(
        W.unboundedPreceding, -1 if exclusive else 0)
    local = rows.select("*", *[KINDS[kind][0](c).over(inside).alias(n)
                               for n, (kind, c) in values.items()])
    edges = edge_keys(rows, keys, block)
    split = rows.join(F.broadcast(edges), _same(list(keys), key_names), "left_semi")

    def whole(kind, c):
        if kind not in ("first", "last"):
            return KINDS[kind][0](c)
        latest = (kind == "last") != backward
        return (F.max_by if latest else F.min_by)(c, F.when(c.isNotNull(), F.struct(*order)))
    totals = split.groupBy(block, *keys).agg(
        *[whole(kind, c).alias(f"_t_{n}") for n, (kind, c) in values.items()])
    before = W.partitionBy(*keys).orderBy(*along([block])).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        F.col(block).alias("_cb"), *[F.col(k).alias(n) for k, n in zip(keys, key_names)],
        *[KINDS[kind][0](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}")
          for n, (kind, _) in values.items()])
    out = local.join(F.broadcast(carried), (F.col(block) == F.col("_cb"))
                     & _same(list(keys), key_names), "left")
    both = {n: F.when(F.col(f"_c_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_c_{n}"))
            .otherwise(KINDS[kind][1](F.col(f"_c_{n}"), F.col(n)))
            for n, (kind, _) in values.items()}
    return out.select(*[c for c in local.columns if c not in names],
                      *[c.alias(n) for n, c in both.items()])
