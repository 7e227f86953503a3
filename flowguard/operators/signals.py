"""Signals: identities of matches and of signature events."""

from pyspark.sql import DataFrame, functions as F

from flowguard import constants as K
from flowguard.functions.flow_columns import bucket, signature_severity
from flowguard.functions.hashing import canonical_hash, iso_offset, json_object, lane_names, \
    lane_parts, lanes_to_digest

SIGNAL_COLUMNS = ["semantic_key", "series_key", "source_type", "rule_version_id", "category",
                  "severity", "sensor_id", "bucket_start", "bucket_end", "grouping",
                  "observed_value", "threshold_value", "evidence_count", "evidence_digest"]


def _group_map(names) -> F.Column:
    """Grouping as a map; keys without a value are left out."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value"))
                        for n in sorted(names) if n != "sensor_id"])
    sensor = F.struct(F.lit("sensor_id").alias("key"),
                      F.coalesce(F.col("sensor_id"), F.lit(K.UNSPECIFIED_SENSOR)).alias("value"))
    held = F.filter(F.array_append(entries, sensor), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.array_sort(held))


def with_signal_keys(matches: DataFrame) -> DataFrame:
    """Behavioural matches as signals.

    The series key names rule, group and bucket; the semantic key adds the evidence,
    so a grown evidence set makes a new signal of the same series.
    """
    group = _group_map(["src_address", "dst_address", "dst_port", "protocol"])
    series = canonical_hash(
        source_type=F.lit("behavioral_rule"), rule_version_id=F.col("rule_version_id"),
        rule_key=F.col("rule_key"), group=F.col("grouping"),
        bucket_start=iso_offset(F.col("bucket_start")), window_seconds=F.col("window_seconds"))
    return (matches.withColumn("grouping", group)
            .withColumn("series_key", series)
            .withColumn("source_type", F.lit("behavioral_rule"))
            .withColumn("semantic_key", canonical_hash(series=F.col("series_key"),
                                                       evidence=F.col("evidence_digest")))
            .select(*SIGNAL_COLUMNS))


def signature_signals(events: DataFrame) -> DataFrame:
    """One signal per signature event, in series of one minute per group."""
    width = K.SIGNATURE_WINDOW_SECONDS
    start = bucket(F.col("event_time"), width)
    group = json_object(
        sensor_id=F.coalesce(F.col("sensor_id"), F.lit(K.UNSPECIFIED_SENSOR)),
        src_address=F.col("src_address"), dst_address=F.col("dst_address"),
        dst_port=F.coalesce(F.col("dst_port"), F.lit(0)), protocol=F.col("protocol"),
        signature_id=F.col("signature_id"), signature_revision=F.col("signature_revision"))
    lanes = [v.alias(n) for v, n in zip(lane_parts(F.col("event_key")), lane_names())]
    rows = (events.select("*", start.alias("bucket_start"), *lanes)
            .withColumn("evidence_digest", lanes_to_digest(F.lit(1)))
            .withColumn("series_key", canonical_hash(
                source_type=F.lit("suricata_signature"), group=group,
                bucket_start=iso_offset(F.col("bucket_start")), window_seconds=F.lit(width))))
    return rows.select(
        canonical_hash(series=F.col("series_key"),
                       evidence=F.col("evidence_digest")).alias("semantic_key"),
        "series_key", F.lit("suricata_signature").alias("source_type"),
        F.lit(None).cast("string").alias("rule_version_id"), "category",
        signature_severity(F.col("reported_severity")).alias("severity"), "sensor_id",
        "bucket_start",
        F.timestamp_micros(F.unix_micros("bucket_start") + width * 1_000_000).alias("bucket_end"),
        F.from_json(F.to_json(group), "map<string,string>").alias("grouping"),
        F.lit(1).cast("long").alias("observed_value"),
        F.lit(1).cast("long").alias("threshold_value"),
        F.lit(1).cast("long").alias("evidence_count"), "evidence_digest")


def novel_signals(signals: DataFrame, known: DataFrame) -> DataFrame:
    """Signals whose semantic key was not stored before, one row per key."""
    return (signals.dropDuplicates(["semantic_key"])
            .join(known.select("semantic_key"), "semantic_key", "left_anti"))


def signal_counts(signals: DataFrame, known: DataFrame) -> DataFrame:
    """How many signals are new and how many are suppressed."""
    keyed = signals.groupBy("semantic_key").agg(F.count(F.lit(1)).alias("copies"))
    seen = known.select("semantic_key", F.lit(True).alias("_seen")).distinct()
    fresh = F.count_if(F.col("_seen").isNull())
    return (keyed.join(seen, "semantic_key", "left")
            .agg(fresh.alias("created"), (F.coalesce(F.sum("copies"), F.lit(0)) - fresh)
                 .alias("suppressed")))
