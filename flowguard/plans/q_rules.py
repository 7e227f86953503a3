"""Rules, signals and incremental evaluation."""

from pyspark.sql import functions as F

from flowguard.functions.flow_columns import bucket, signature_severity
from flowguard.operators import ledger, rules, signals
from flowguard.plans import bindings as B
from flowguard.plans.registry import query

RULE_SQL_COLUMNS = """rule_key, bucket_us, coalesce(sensor_id, 'unspecified') AS sensor,
  src_address, dst_address, CAST(dst_port AS BIGINT) AS dst_port, protocol,
  CAST(observed_value AS BIGINT) AS observed_value,
  CAST(threshold_value AS BIGINT) AS threshold_value, CAST(n AS BIGINT) AS evidence_count"""


def shaped(matches):
    return matches.select(
        "rule_key", B.micros("bucket_start").alias("bucket_us"),
        F.coalesce("sensor_id", F.lit("unspecified")).alias("sensor"), "src_address",
        "dst_address", F.col("dst_port").cast("long").alias("dst_port"), "protocol",
        "observed_value", "threshold_value", "evidence_count", "evidence_digest")


def rule_sql(rule, source="matches"):
    return f"""WITH {B.FLOWS}, {B.sql_matches()}
SELECT {RULE_SQL_COLUMNS}, {B.sql_digest()} AS evidence_digest FROM {source}
WHERE rule_key = '{rule.rule_key}'"""


@query("agg_1_time_bucket", f"""WITH {B.FLOWS}
SELECT (t_us // 300000000) * 300000000 AS bucket_us, count(*) AS flows,
  CAST(sum(byte_count) AS BIGINT) AS total_bytes FROM flows GROUP BY 1""")
def agg_1(spark, sf):
    return (B.flows(spark, sf).groupBy(bucket(F.col("event_time"), 300).alias("b"))
            .agg(F.count(F.lit(1)).alias("flows"), F.sum("byte_count").alias("total_bytes"))
            .select(B.micros("b").alias("bucket_us"), "flows", "total_bytes"))


@query("agg_2_port_scan", rule_sql(B.SCAN))
def agg_2(spark, sf):
    return shaped(rules.port_scan(B.flows(spark, sf), B.SCAN))


@query("agg_3_repeated_failure", rule_sql(B.FAILURE))
def agg_3(spark, sf):
    return shaped(rules.repeated_failure(B.flows(spark, sf), B.FAILURE))


@query("agg_4_high_rate", rule_sql(B.RATE))
def agg_4(spark, sf):
    return shaped(rules.high_rate(B.flows(spark, sf), B.RATE))


@query("agg_2_4_evidence", f"""WITH {B.FLOWS}, {B.sql_matches()}
SELECT m.rule_key, m.bucket_us, coalesce(m.sensor_id, 'unspecified') AS sensor, m.src_address,
  f.event_key
FROM matches m JOIN flows f ON f.bucket_us = m.bucket_us
  AND f.sensor_id IS NOT DISTINCT FROM m.sensor_id AND f.src_address = m.src_address
  AND (m.rule_key = '{B.RATE.rule_key}' OR (f.dst_address = m.dst_address
       AND f.dst_port IS NOT NULL))
  AND (m.rule_key <> '{B.FAILURE.rule_key}' OR (f.failed AND f.dst_port = m.dst_port
       AND f.protocol = m.protocol))""")
def evidence(spark, sf):
    flows = B.flows(spark, sf)
    out = None
    for rule in B.RULES:
        hits = rules.EVALUATORS[rule.evaluator_key](flows, rule, True)
        part = rules.evidence(flows, rule, hits).select(
            "rule_key", B.micros("bucket_start").alias("bucket_us"),
            F.coalesce("sensor_id", F.lit("unspecified")).alias("sensor"), "src_address",
            "event_key")
        out = part if out is None else out.unionByName(part)
    return out


@query("jn_5_rule_set", f"""WITH {B.FLOWS}, {B.sql_matches()}
SELECT {RULE_SQL_COLUMNS}, {B.sql_digest()} AS evidence_digest FROM matches""")
def jn_5(spark, sf):
    return shaped(rules.evaluate_rules(B.flows(spark, sf), B.RULES))


@query("jn_3_touched_buckets", f"""WITH {B.FLOWS}
SELECT event_key, bucket_us FROM flows
WHERE t_us // 600000000 IN (SELECT t_us // 600000000 FROM flows WHERE job_id = 'job-new')""")
def jn_3(spark, sf):
    flows = B.flows(spark, sf)
    return rules.touched_flows(flows, B.new_flows(spark, sf), 600).select(
        "event_key", B.micros(bucket(F.col("event_time"), B.DAY)).alias("bucket_us"))


EXCLUDED = ("asset-2", "asset-5", "asset-9")


@query("jn_4_source_exclusion", f"""WITH {B.FLOWS}, {B.ASSETS}
SELECT event_key, src_address FROM flows WHERE src_address NOT IN (
  SELECT address FROM assets WHERE asset_id IN ({B.sql_list(EXCLUDED)}) AND address IS NOT NULL)""")
def jn_4(spark, sf):
    return rules.exclude_assets(B.flows(spark, sf), B.assets(spark, sf), EXCLUDED).select(
        "event_key", "src_address")


@query("agg_6_signal_identity", f"""WITH {B.SIGNALS}
SELECT rule_key, bucket_us, series_key, evidence_digest, semantic_key FROM signals""")
def agg_6(spark, sf):
    matches = rules.evaluate_rules(B.flows(spark, sf), B.RULES, unique=True)
    names = {r.category: r.rule_key for r in B.RULES}
    key = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return signals.with_signal_keys(matches).select(
        F.element_at(key, F.col("category")).alias("rule_key"),
        B.micros("bucket_start").alias("bucket_us"), "series_key", "evidence_digest",
        "semantic_key")


@query("jn_6_signal_novelty", f"""WITH {B.SIGNALS}
SELECT count(*) FILTER (WHERE o.semantic_key IS NULL) AS created,
  count(*) FILTER (WHERE o.semantic_key IS NOT NULL) AS suppressed
FROM signals s LEFT JOIN (SELECT DISTINCT semantic_key FROM old_signals) o USING (semantic_key)""")
def jn_6(spark, sf):
    return signals.signal_counts(*B.all_signals(spark, sf))


@query("jn_6_novel_signals", f"""WITH {B.SIGNALS}
SELECT semantic_key, series_key, category, severity FROM signals
WHERE semantic_key NOT IN (SELECT semantic_key FROM old_signals)""")
def jn_6_rows(spark, sf):
    return signals.novel_signals(*B.all_signals(spark, sf)).select(
        "semantic_key", "series_key", "category", "severity")


def signature_events(spark, sf):
    """All events as reported signatures."""
    return B.flows(spark, sf).select(
        "event_key", "event_time", "sensor_id", "src_address", "dst_address", "dst_port",
        "protocol", (F.col("k") % 5 + 2_100_000).cast("int").alias("signature_id"),
        F.lit(1).alias("signature_revision"), F.lit("policy").alias("category"),
        (F.col("k") % 5).cast("int").alias("reported_severity"))


SIGNATURE_GROUP = """'{"dst_address":"' || dst_address || '","dst_port":'
    || coalesce(dst_port, 0) || ',"protocol":"' || protocol || '","sensor_id":"' || coalesce(sensor_id, 'unspecified')
    || '","signature_id":' || (k % 5 + 2100000) || ',"signature_revision":1,"src_address":"'
    || src_address || '"}'"""
MINUTE = "(t_us // 60000000) * 60000000"


@query("agg_5_signature_signals", f"""WITH {B.FLOWS},
s AS (SELECT *, {MINUTE} AS m_us, {SIGNATURE_GROUP} AS grouping,
  {', '.join(f"CAST('0x' || substr(sha256(event_key), {1 + 12 * i}, 12) AS BIGINT) AS lane{i}"
             for i in range(4))}
  FROM flows),
d AS (SELECT *, {B.sql_digest('1')} AS evidence_digest,
  sha256('{{"bucket_start":"' || {B.ISO.format('m_us')} || '","group":' || grouping
    || ',"source_type":"suricata_signature","window_seconds":60}}') AS series_key FROM s)
SELECT event_time_us AS bucket_us, series_key, severity, semantic_key FROM (
  SELECT m_us AS event_time_us, series_key, CASE k % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'medium'
    WHEN 3 THEN 'low' ELSE 'informational' END AS severity,
    sha256('{{"evidence":"' || evidence_digest || '","series":"' || series_key || '"}}')
      AS semantic_key FROM d)""")
def agg_5(spark, sf):
    return signals.signature_signals(signature_events(spark, sf)).select(
        B.micros("bucket_start").alias("bucket_us"), "series_key", "severity", "semantic_key")


@query("prj_10_signature_severity", f"""WITH {B.EVENTS}
SELECT CASE k % 6 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low'
  ELSE 'informational' END AS severity, count(*) AS n FROM ev GROUP BY 1""")
def prj_10(spark, sf):
    return B.events(spark, sf).groupBy(signature_severity(F.col("k") % 6).alias("severity")).agg(
        F.count(F.lit(1)).alias("n"))


@query("jn_1_new_events", f"""WITH {B.FLOWS}
SELECT event_key FROM flows WHERE event_key NOT IN (
  SELECT event_key FROM flows WHERE event_id % 3 = 0)""")
def jn_1(spark, sf):
    flows = B.flows(spark, sf)
    twice = flows.unionByName(flows.where("event_id % 7 = 0"))
    return ledger.new_events(twice, flows.where("event_id % 3 = 0")).select("event_key")


@query("jn_2_conflicts", f"""WITH {B.FLOWS}
SELECT event_key, CAST(2 AS BIGINT) AS copies FROM flows WHERE event_id % 7 = 1""")
def jn_2(spark, sf):
    flows = B.flows(spark, sf).drop("metadata", "user_id", "k", "event_type", "value", "event_id")
    base = B.flows(spark, sf)
    same = base.where("event_id % 7 = 0").select(*flows.columns)
    other = base.where("event_id % 7 = 1").withColumn("byte_count", F.col("byte_count") + 1) \
        .select(*flows.columns)
    return ledger.conflicts(flows.unionByName(same).unionByName(other))


@query("jn_2_dedup", f"WITH {B.FLOWS} SELECT src_address, count(*) AS n FROM flows GROUP BY 1")
def jn_2_dedup(spark, sf):
    flows = B.flows(spark, sf)
    return ledger.dedup(flows.unionByName(flows)).groupBy("src_address").agg(
        F.count(F.lit(1)).alias("n"))


@query("src_7_replay", f"""WITH {B.FLOWS}
SELECT 'job-old' AS job_id, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS rejected,
  count(*) AS duplicate FROM flows WHERE job_id = 'job-old'""")
def src_7(spark, sf):
    return ledger.replay(B.flows(spark, sf), "job-old")[1]


@query("src_7_replay_signals", f"""WITH {B.SIGNALS}
SELECT semantic_key, category FROM old_signals""")
def src_7_signals(spark, sf):
    batch, _ = ledger.replay(B.flows(spark, sf), "job-old")
    return signals.with_signal_keys(rules.evaluate_rules(batch, B.RULES, unique=True)).select(
        "semantic_key", "category")
