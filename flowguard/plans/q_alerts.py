"""Alerts and incidents."""

from datetime import timedelta

from pyspark.sql import functions as F

from flowguard.operators import alerts as A, incidents as I
from flowguard.plans import bindings as B
from flowguard.plans.registry import query

START, END = B.utc(2024, 1, 5), B.utc(2024, 1, 25)
START_US, END_US = (int(t.timestamp()) * 1_000_000 for t in (START, END))


def group_text():
    return F.concat_ws(",", F.transform(F.map_entries("grouping"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])))


GROUP_SQL = """concat_ws(',', 'dst_address=' || dst_address, 'dst_port=' || dst_port,
  'protocol=' || protocol, 'sensor_id=' || coalesce(sensor_id, 'unspecified'),
  'src_address=' || src_address)"""


@query("agg_7_alert_rollup", f"""WITH {B.MERGED_ALERTS}
SELECT fingerprint, category, severity, CAST(occurrence_count AS BIGINT) AS occurrence_count,
  first_us, last_us FROM alerts""")
def agg_7(spark, sf):
    return B.merged_alerts(spark, sf).select(
        "fingerprint", "category", "severity", "occurrence_count",
        B.micros("first_seen").alias("first_us"), B.micros("last_seen").alias("last_us"))


def category_signals(spark, sf):
    """Signals in one series per category and month: many signals per alert."""
    now, _ = B.all_signals(spark, sf)
    return now.withColumn("series_key", F.sha2("category", 256))


@query("agg_8_evidence_kept", f"""WITH {B.SIGNALS},
r AS (SELECT sha256('{{"fingerprint_schema":"alert-fingerprint/v1","series_key":"'
    || sha256(category) || '"}}') AS fp, semantic_key, bucket_us,
    row_number() OVER (PARTITION BY category ORDER BY bucket_us, semantic_key) AS position
  FROM signals)
SELECT fp AS fingerprint, semantic_key, CAST(position AS BIGINT) AS position FROM r
WHERE position <= 20""")
def agg_8_kept(spark, sf):
    kept, _ = A.bounded_evidence(category_signals(spark, sf), 20)
    return kept.select("fingerprint", "semantic_key", F.col("position").cast("long")
                       .alias("position"))


SNAPSHOT_SQL = f"""sha256('{{"bucket_end":"' || {B.ISO.format('bucket_end_us')}
    || '","bucket_start":"' || {B.ISO.format('bucket_us')} || '","evidence_hash":"'
    || evidence_digest || '","evidence_schema":"alert-evidence/v1","group":' || grouping
    || ',"observed":' || observed_value || ',"rule_version_id":"1","source_type":"behavioral_rule"'
    || ',"threshold":' || threshold_value || '}}')"""


@query("agg_8_evidence_overflow", f"""WITH {B.SIGNALS},
r AS (SELECT category, {SNAPSHOT_SQL} AS snapshot,
    row_number() OVER (PARTITION BY category ORDER BY bucket_us, semantic_key) AS position
  FROM signals),
o AS (SELECT category, count(*) AS n, {B.sql_lanes('snapshot')} FROM r WHERE position > 20
  GROUP BY category)
SELECT sha256('{{"fingerprint_schema":"alert-fingerprint/v1","series_key":"' || sha256(c.category)
    || '"}}') AS fingerprint, CAST(coalesce(n, 0) AS BIGINT) AS overflow_count,
  CASE WHEN n > 0 THEN {B.sql_digest()} END AS overflow_digest
FROM (SELECT DISTINCT category FROM signals) c LEFT JOIN o USING (category)""")
def agg_8_overflow(spark, sf):
    return A.bounded_evidence(category_signals(spark, sf), 20)[1]


@query("srt_1_alerts_between", f"""WITH {B.MERGED_ALERTS}
SELECT fingerprint, last_us, severity FROM alerts WHERE last_us BETWEEN {START_US} AND {END_US}
ORDER BY last_us DESC, fingerprint LIMIT 50""")
def srt_1(spark, sf):
    return A.alerts_between(B.merged_alerts(spark, sf), START, END, 50).select(
        "fingerprint", B.micros("last_seen").alias("last_us"), "severity")


@query("srt_2_flows_between", f"""WITH {B.FLOWS}
SELECT event_key, t_us, src_address FROM flows WHERE t_us >= {START_US} AND t_us < {END_US}
ORDER BY t_us DESC, event_key DESC LIMIT 100""")
def srt_2(spark, sf):
    return A.flows_between(B.flows(spark, sf), START, END, 100).select(
        "event_key", B.micros("event_time").alias("t_us"), "src_address")


@query("srt_3_alert_detail", f"""WITH {B.MERGED_ALERTS},
e AS (SELECT fingerprint, bucket_us, row_number() OVER (PARTITION BY fingerprint
    ORDER BY bucket_us, {SNAPSHOT_SQL}) AS position, {SNAPSHOT_SQL} AS evidence_hash FROM signals)
SELECT a.fingerprint, CAST(a.occurrence_count AS BIGINT) AS occurrence_count,
  e.evidence_hash, e.bucket_us AS occurred_us, CAST(e.position AS BIGINT) AS position
FROM alerts a LEFT JOIN e ON e.fingerprint = a.fingerprint AND position <= 100""")
def srt_3(spark, sf):
    now, _ = B.all_signals(spark, sf)
    kept, _ = A.bounded_evidence(now)
    return A.alert_detail(B.merged_alerts(spark, sf), kept).select(
        "fingerprint", "occurrence_count", "evidence_hash",
        B.micros("occurred_at").alias("occurred_us"), F.col("position").cast("long")
        .alias("position"))


@query("prj_17_masked_groups", f"""WITH {B.SIGNALS}
SELECT fingerprint, {GROUP_SQL} AS full_group,
  concat_ws(',', 'dst_port=' || dst_port, 'protocol=' || protocol,
    'sensor_id=' || coalesce(sensor_id, 'unspecified')) AS masked_group FROM signals""")
def prj_17(spark, sf):
    from flowguard.functions.flow_columns import mask_group
    now, _ = B.all_signals(spark, sf)
    return now.select(A.fingerprint(F.col("series_key")).alias("fingerprint"),
                      group_text().alias("full_group"),
                      mask_group(F.col("grouping"), False).alias("grouping")) \
        .select("fingerprint", "full_group", group_text().alias("masked_group"))


def rule_versions(spark, sf):
    """Parts as rule versions: the brand is the rule, the part its version."""
    return B.table(spark, sf, "part").select(
        F.col("p_brand").alias("rule_key"), F.col("p_partkey").alias("version"),
        (F.col("p_size") % 5 == 0).alias("is_active"))


@query("srt_4_rule_catalogue", """
WITH r AS (SELECT p_brand AS rule_key, p_partkey AS version, p_size % 5 = 0 AS is_active FROM part)
SELECT rule_key, version, version = (SELECT max(version) FROM r AS x WHERE x.rule_key = r.rule_key)
    AS is_latest,
  (SELECT max(version) + 1 FROM r AS x WHERE x.rule_key = r.rule_key) AS next_version
FROM r WHERE is_active""")
def srt_4(spark, sf):
    return A.latest_versions(rule_versions(spark, sf), active_only=True).select(
        "rule_key", "version", "is_latest", "next_version")


INCIDENT_NOW = B.utc(2024, 2, 10)
SINCE_US = int((INCIDENT_NOW - timedelta(days=30)).timestamp()) * 1_000_000
KEY_SQL = "sha256('incident-correlation/v1:' || category)"


@query("agg_17_incidents", f"""WITH {B.MERGED_ALERTS},
g AS (SELECT category, count(*) AS n, {B.sql_lanes('fingerprint')} FROM alerts
  WHERE last_us >= {SINCE_US} GROUP BY category)
SELECT {KEY_SQL} AS correlation_key, category, n AS alert_count,
  {B.sql_digest()} AS members_digest FROM g""")
def agg_17(spark, sf):
    return I.correlate_alerts(B.merged_alerts(spark, sf), INCIDENT_NOW)


@query("agg_17_incident_members", f"""WITH {B.MERGED_ALERTS}
SELECT {KEY_SQL} AS correlation_key, category, fingerprint FROM alerts
WHERE last_us >= {SINCE_US}""")
def agg_17_members(spark, sf):
    return I.correlated_members(B.merged_alerts(spark, sf), INCIDENT_NOW)


def attached(members):
    return members.where("fingerprint < '8'")


@query("jn_13_new_members", f"""WITH {B.MERGED_ALERTS},
m AS (SELECT {KEY_SQL} AS correlation_key, fingerprint FROM alerts WHERE last_us >= {SINCE_US})
SELECT correlation_key, count(*) FILTER (WHERE fingerprint >= '8') AS added,
  count(*) AS alert_count FROM m GROUP BY 1 HAVING added > 0""")
def jn_13(spark, sf):
    members = I.correlated_members(B.merged_alerts(spark, sf), INCIDENT_NOW)
    return I.member_counts(members, attached(members))


@query("srt_5_incident_detail", f"""WITH {B.MERGED_ALERTS},
m AS (SELECT {KEY_SQL} AS correlation_key, category, fingerprint, first_us FROM alerts
  WHERE last_us >= {SINCE_US})
SELECT correlation_key, category, 'open' AS status, 'member' AS kind, fingerprint AS detail FROM m
UNION ALL
SELECT correlation_key, category, 'open', 'timeline', 'created' FROM m GROUP BY 1, 2""")
def srt_5(spark, sf):
    found = B.merged_alerts(spark, sf)
    members = I.correlated_members(found, INCIDENT_NOW)
    incidents = I.correlate_alerts(found, INCIDENT_NOW).withColumn("status", F.lit("open"))
    timeline = incidents.select("correlation_key", F.lit(INCIDENT_NOW).alias("at"),
                                F.lit("created").alias("detail"))
    return I.incident_detail(incidents, members, timeline).select(
        "correlation_key", "category", "status", "kind", "detail")
