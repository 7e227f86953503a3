"""Files written: flows as JSON lines, targets apart from features."""

from pyspark.sql import DataFrame, functions as F

from flowguard.functions.hashing import canonical_json, iso_z, sorted_map
from flowguard.sources.lines import FLOW_TYPES


def flow_lines(df: DataFrame) -> DataFrame:
    """Canonical flows as JSON text: keys sorted, nulls kept."""
    def value(c):
        if c == "event_time":
            return iso_z(F.col(c))
        return sorted_map(F.col(c)) if c == "metadata" else F.col(c)
    return df.select(canonical_json(F.struct(*[value(c).alias(c) for c in sorted(FLOW_TYPES)]))
                     .alias("value"))


def write_flows_jsonl(df: DataFrame, path: str) -> None:
    flow_lines(df).write.mode("overwrite").text(path)


def write_targets(df: DataFrame, path: str, key: str = "event_key",
                  columns=("label", "family", "group_id", "partition")) -> None:
    """Labels and partitions in a table of their own, keyed by identity."""
    df.select(key, *columns).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_flows(df: DataFrame, path: str) -> None:
    """Append canonical flows by event date, sorted by source for row-group skipping."""
    (df.withColumn("event_date", F.to_date("event_time"))
     .sortWithinPartitions("event_date", "src_address")
     .write.mode("append").partitionBy("event_date").parquet(path))
