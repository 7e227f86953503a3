"""Alerts: roll-up of signals, bounded evidence, lists and details."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowguard import constants as K
from flowguard.functions.flow_columns import mask_group
from flowguard.functions.hashing import canonical_hash, iso_offset, lane_names, lane_sums, \
    lanes_to_digest, sorted_map

ALERT_COLUMNS = ["fingerprint", "source_type", "category", "severity", "rule_version_id",
                 "sensor_id", "grouping", "occurrence_count", "first_seen", "last_seen"]


def fingerprint(series_key: Column) -> Column:
    return canonical_hash(fingerprint_schema=F.lit(K.ALERT_FINGERPRINT_SCHEMA),
                          series_key=series_key)


def rollup_alerts(signals: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One alert per series; current alerts are merged in the same aggregation.

    Signals have to be novel already. A current alert keeps its own description,
    the counts add up and the time span widens.
    """
    about = ["source_type", "category", "severity", "rule_version_id", "sensor_id"]
    new = signals.select(
        fingerprint(F.col("series_key")).alias("fingerprint"), F.lit(1).alias("_rank"),
        F.struct(*about, F.map_entries(sorted_map(F.col("grouping"))).alias("grouping"))
        .alias("_about"),
        F.lit(1).cast("long").alias("_n"), F.col("bucket_start").alias("_from"),
        F.col("bucket_end").alias("_to"))
    rows = new
    if current is not None:
        rows = new.unionByName(current.select(
            "fingerprint", F.lit(0).alias("_rank"),
            F.struct(*about, F.map_entries(sorted_map(F.col("grouping"))).alias("grouping"))
            .alias("_about"),
            F.col("occurrence_count").cast("long").alias("_n"), F.col("first_seen").alias("_from"),
            F.col("last_seen").alias("_to")))
    return (rows.groupBy("fingerprint")
            .agg(F.min(F.struct("_rank", "_about")).alias("_pick"),
                 F.sum("_n").alias("occurrence_count"), F.min("_from").alias("first_seen"),
                 F.max("_to").alias("last_seen"))
            .select("fingerprint", *[F.col(f"_pick._about.{c}").alias(c) for c in about],
                    F.map_from_entries("_pick._about.grouping").alias("grouping"),
                    "occurrence_count", "first_seen", "last_seen")
            .select(*ALERT_COLUMNS))


def snapshot_hash() -> Column:
    """Identity of the evidence a signal contributes to its alert."""
    return canonical_hash(
        evidence_schema=F.lit(K.EVIDENCE_SCHEMA), source_type=F.col("source_type"),
        rule_version_id=F.col("rule_version_id"), group=sorted_map(F.col("grouping")),
        bucket_start=iso_offset(F.col("bucket_start")),
        bucket_end=iso_offset(F.col("bucket_end")), observed=F.col("observed_value"),
        threshold=F.col("threshold_value"), evidence_hash=F.col("evidence_digest"))


def bounded_evidence(signals: DataFrame, n: int = K.MAX_EVIDENCE_PER_ALERT
                     ) -> tuple[DataFrame, DataFrame]:
    """(kept, overflow): the first n snapshots per alert, and what lies beyond them.

    Ranking keeps at most n rows per alert before the shuffle. The overflow digest is
    the digest of all snapshots less that of the kept ones, so no alert is gathered.
    """
    rows = signals.select(fingerprint(F.col("series_key")).alias("fingerprint"), "semantic_key",
                          F.col("bucket_start").alias("occurred_at"),
                          snapshot_hash().alias("evidence_hash"))
    first = W.partitionBy("fingerprint").orderBy("occurred_at", "semantic_key")
    kept = (rows.withColumn("position", F.row_number().over(first))
            .where(F.col("position") <= n))
    whole = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_n"),
                                            *lane_sums(F.col("evidence_hash")))
    part = kept.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_kn"),
                                           *lane_sums(F.col("evidence_hash"), "_kept"))
    rest = (whole.join(part, "fingerprint")
            .withColumn("overflow_count", F.col("_n") - F.col("_kn"))
            .select("fingerprint", "overflow_count",
                    *[(F.col(n) - F.col(k)).alias(n)
                      for n, k in zip(lane_names(), lane_names("_kept"))]))
    overflow = rest.select("fingerprint", "overflow_count", F.when(
        F.col("overflow_count") > 0, lanes_to_digest(F.col("overflow_count")))
        .alias("overflow_digest"))
    return kept, overflow


def alerts_between(alerts: DataFrame, start, end, n: int, sensitive: bool = False) -> DataFrame:
    """The newest n alerts seen in a span of at most 31 days."""
    if (end - start).days > 31 or end < start:
        raise ValueError("time range out of bounds")
    return (alerts.where(F.col("last_seen").between(F.lit(start), F.lit(end)))
            .orderBy(F.col("last_seen").desc(), "fingerprint").limit(n)
            .withColumn("grouping", mask_group(F.col("grouping"), sensitive)))


def flows_between(flows: DataFrame, start, end, n: int) -> DataFrame:
    """The newest n flows of [start, end)."""
    return (flows.where((F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(end)))
            .orderBy(F.col("event_time").desc(), F.col("event_key").desc()).limit(n))


def alert_detail(alerts: DataFrame, evidence: DataFrame, n: int = 100,
                 sensitive: bool = False) -> DataFrame:
    """Alerts with their first n evidence rows by time, masked."""
    first = W.partitionBy("fingerprint").orderBy("occurred_at", "evidence_hash")
    rows = (evidence.select("fingerprint", "occurred_at", "evidence_hash")
            .withColumn("position", F.row_number().over(first)).where(F.col("position") <= n))
    return (alerts.withColumn("grouping", mask_group(F.col("grouping"), sensitive))
            .join(rows, "fingerprint", "left"))


def latest_versions(rules: DataFrame, active_only: bool = False) -> DataFrame:
    """Rule versions, newest first per key, which is the latest, and the next number."""
    top = rules.groupBy("rule_key").agg(F.max("version").alias("_top"))
    rows = rules.where("is_active") if active_only else rules
    return (rows.join(top, "rule_key")
            .select(*rules.columns, (F.col("version") == F.col("_top")).alias("is_latest"),
                    (F.col("_top") + 1).alias("next_version"))
            .orderBy("rule_key", F.col("version").desc()))
