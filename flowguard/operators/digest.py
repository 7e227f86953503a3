"""Order-free digests of row sets.

A set is identified by its size and four sums over hash lanes. Sums combine on
the map side, so neither a hot key nor the whole table is ever gathered.
"""

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions.hashing import lane_sums, lane_totals, lanes_to_digest


def set_digest(df: DataFrame, key: Column | str, by=(), distinct: bool = True) -> DataFrame:
    """One row per ``by`` group with ``n`` and ``digest`` of its set of keys."""
    key = F.col(key) if isinstance(key, str) else key
    rows = df.select(*by, key.alias("_key"))
    if distinct:
        rows = rows.distinct()
    return (rows.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), *lane_sums(F.col("_key")))
            .select(*by, "n", lanes_to_digest(F.col("n")).alias("digest")))


def row_key(df: DataFrame) -> Column:
    """Text form of a whole row, columns in alphabetical order."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]),
                     {"ignoreNullFields": "false"})


def content_digest(df: DataFrame, by=()) -> DataFrame:
    """Row count, column count and content digest of a table, or of each of its parts.

    Duplicates count.
    """
    return (set_digest(df, row_key(df), by, distinct=False)
            .select(*by, F.col("n").alias("row_count"),
                    F.lit(len(df.columns)).cast("long").alias("column_count"), "digest"))


__all__ = ["set_digest", "row_key", "content_digest", "lane_sums", "lane_totals",
           "lanes_to_digest"]
