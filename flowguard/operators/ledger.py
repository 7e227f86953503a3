"""Deduplication against what was processed before, and within a batch."""

from pyspark.sql import Column, DataFrame, functions as F

IDENTITY = ["event_key", "schema_version"]


def new_events(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose identity is not in the ledger yet, one row per identity."""
    return (events.dropDuplicates(IDENTITY)
            .join(ledger.select(*IDENTITY), IDENTITY, "left_anti"))


def ledger_rows(events: DataFrame) -> DataFrame:
    """What has to be appended to the ledger for accepted events."""
    return events.select(*IDENTITY, F.current_timestamp().alias("processed_at"))


def dedup(df: DataFrame, key: str = "event_key") -> DataFrame:
    return df.dropDuplicates([key])


def conflicts(df: DataFrame, key: str = "event_key", content: Column | None = None) -> DataFrame:
    """Keys that occur with different contents: min and max hash differ."""
    if content is None:
        content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]),
                                   {"ignoreNullFields": "false"}), 256)
    return (df.select(key, content.alias("_c")).groupBy(key)
            .agg(F.min("_c").alias("_a"), F.max("_c").alias("_z"),
                 F.count(F.lit(1)).alias("copies"))
            .where("_a <> _z").select(key, "copies"))


def replay(flows: DataFrame, job_id: str) -> tuple[DataFrame, DataFrame]:
    """An earlier job's flows for a new evaluation, and its counts: all duplicates."""
    batch = flows.where(F.col("job_id") == job_id)
    n = F.count(F.lit(1))
    return batch, batch.agg(F.lit(job_id).alias("job_id"), F.lit(0).cast("long").alias("accepted"),
                            F.lit(0).cast("long").alias("rejected"), n.alias("duplicate"))
