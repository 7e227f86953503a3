"""Readers over lines made of the given tables, packets, outcomes and sinks."""

from pyspark.sql import functions as F

from flowguard.functions.hashing import canonical_json, iso_z
from flowguard.operators import digest as D, features
from flowguard.plans import bindings as B
from flowguard.plans.q_columns import QUOTED, Z_TIME
from flowguard.plans.registry import query
from flowguard.session import scratch
from flowguard.sources import outcomes, readers, sinks


def flow_json_lines(spark, sf):
    """Flows as canonical JSON lines; some are cut off, blank, odd or without a zone."""
    f, w = B.flows(spark, sf), F.col("event_id") % 20
    good = F.struct(
        *[F.col(c) for c in ("schema_version", "source_event_id")],
        F.when(w == 3, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(iso_z(F.col("event_time"))).alias("event_time"),
        F.when(w == 4, "999.1.1.1").otherwise(F.col("src_address")).alias("src_address"),
        "dst_address", "src_port", "dst_port", "protocol", "duration_ms", "packet_count",
        "byte_count", "state")
    line = canonical_json(good)
    line = (F.when(w == 1, F.substring(line, 1, 40)).when(w == 2, F.lit("   "))
            .when(w == 5, F.regexp_replace(line, r"\}$", ',"label":"x"}'))
            .when(w == 6, F.concat(line, F.repeat(F.lit(" "), 66_000))).otherwise(line))
    return f.select(line.alias("value"), B.text("event_id").alias("input_file"))


@query("src_1_canonical_lines", f"""WITH {B.FLOWS}
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 20 = 2 THEN 'empty_record'
    WHEN event_id % 20 = 6 THEN 'line_too_long'
    WHEN event_id % 20 IN (1, 3, 4, 5) THEN 'invalid_record' END AS error_code,
  CASE WHEN NOT (event_id % 20 BETWEEN 1 AND 6) THEN t_us END AS t_us,
  CASE WHEN NOT (event_id % 20 BETWEEN 1 AND 6) THEN src_address END AS src_address,
  CASE WHEN NOT (event_id % 20 BETWEEN 1 AND 6) THEN CAST(dst_port AS BIGINT) END AS dst_port,
  CASE WHEN NOT (event_id % 20 BETWEEN 1 AND 6) THEN byte_count END AS byte_count,
  CASE WHEN NOT (event_id % 20 BETWEEN 1 AND 6) THEN state END AS state FROM flows""")
def src_1(spark, sf):
    return readers.parse_flow_lines(flow_json_lines(spark, sf)).select(
        F.col("input_file").alias("id"), "error_code", B.micros("flow.event_time").alias("t_us"),
        "flow.src_address", F.col("flow.dst_port").cast("long").alias("dst_port"),
        "flow.byte_count", "flow.state")


def zeek_lines(spark, sf):
    """Flows as Zeek records in ten files, tab-separated but for the last, with headers."""
    f = B.flows(spark, sf)
    absent = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    part = {
        "ts": (F.unix_micros("event_time") / 1_000_000).cast("decimal(20,6)").cast("string"),
        "uid": B.text("event_id"), "id.orig_h": F.col("src_address"),
        "id.orig_p": absent(F.col("src_port")), "id.resp_h": F.col("dst_address"),
        "id.resp_p": absent(F.col("dst_port")), "proto": F.upper("protocol"),
        "service": F.when(F.col("k") % 3 == 0, "http").otherwise("-"),
        "duration": (F.col("duration_ms") / 1000.0).cast("decimal(20,3)").cast("string"),
        "orig_bytes": B.text("byte_count"), "resp_bytes": F.lit("10"),
        "conn_state": absent(F.col("state")), "orig_pkts": B.text("packet_count"),
        "resp_pkts": F.lit("1"),
    }
    which = F.col("event_id") % 10
    tsv = F.concat_ws("\t", *part.values())
    tsv = F.when(F.col("k") == 7, F.concat(tsv, F.lit("\textra"))).otherwise(tsv)
    as_json = F.to_json(F.struct(*[c.alias(n) for n, c in part.items()]))
    file = F.concat(F.lit("conn-"), which.cast("string"))
    rows = f.select(F.when(which == 9, as_json).otherwise(tsv).alias("value"),
                    file.alias("input_file"))
    head = f.select(file.alias("input_file")).distinct().select(
        F.explode(F.array(F.lit("#separator \\x09"), F.lit("#fields\t" + "\t".join(part)),
                          F.lit("#close x"))).alias("value"), "input_file")
    return head.unionByName(rows)


@query("src_2_zeek_records", f"""WITH {B.FLOWS}
SELECT CAST(event_id AS VARCHAR) AS uid, t_us, CAST(coalesce(src_port, 0) AS BIGINT) AS src_port,
  protocol, duration_ms, packet_count + 1 AS packet_count, byte_count + 10 AS byte_count, state,
  CASE WHEN k % 3 = 0 THEN 'http' END AS service FROM flows
WHERE NOT (k = 7 AND event_id % 10 <> 9)""")
def src_2(spark, sf):
    return readers.parse_zeek_lines(zeek_lines(spark, sf)).where("error_code IS NULL").select(
        F.col("flow.source_event_id").alias("uid"), B.micros("flow.event_time").alias("t_us"),
        F.col("flow.src_port").cast("long").alias("src_port"), "flow.protocol",
        "flow.duration_ms", "flow.packet_count", "flow.byte_count", "flow.state",
        F.try_element_at("flow.metadata", F.lit("service")).alias("service"))


def eve_lines(spark, sf):
    """Clicks as alerts, errors as an unknown kind of event, everything else as flows."""
    f = B.flows(spark, sf)
    kind = F.when(F.col("event_type") == "click", "alert").when(
        F.col("event_type") == "error", "dns").otherwise("flow")
    end = F.col("event_time") + F.expr("make_dt_interval(0, 0, 0, duration_ms / 1000.0BD)")
    doc = F.struct(
        kind.alias("event_type"), iso_z(F.col("event_time")).alias("timestamp"),
        F.col("event_id").alias("flow_id"), F.col("src_address").alias("src_ip"),
        F.col("dst_address").alias("dest_ip"), "src_port", F.col("dst_port").alias("dest_port"),
        F.upper("protocol").alias("proto"),
        F.when(kind == "flow", F.struct(
            F.col("packet_count").alias("pkts_toserver"), F.lit(2).alias("pkts_toclient"),
            F.col("byte_count").alias("bytes_toserver"), F.lit(5).alias("bytes_toclient"),
            iso_z(F.col("event_time")).alias("start"), iso_z(end).alias("end"),
            F.lit("established").alias("state"))).alias("flow"),
        F.when(kind == "alert", F.struct(
            F.lit("allowed").alias("action"), (F.col("k") + 2_100_000).alias("signature_id"),
            F.lit(3).alias("rev"), F.lit("seen").alias("signature"),
            F.lit("policy").alias("category"),
            F.when(F.col("k") == 9, 999).otherwise(2).alias("severity"))).alias("alert"))
    return f.select(F.to_json(doc).alias("value"), B.text("event_id").alias("input_file"))


@query("src_3_eve_flows", f"""WITH {B.FLOWS}
SELECT CAST(event_id AS VARCHAR) AS id, t_us, CAST(coalesce(dst_port, 0) AS BIGINT) AS dst_port,
  duration_ms, packet_count + 2 AS packet_count, byte_count + 5 AS byte_count,
  'established' AS state FROM flows WHERE event_type NOT IN ('click', 'error')""")
def src_3(spark, sf):
    return readers.parse_eve_lines(eve_lines(spark, sf)).where("flow IS NOT NULL").select(
        F.col("flow.source_event_id").alias("id"), B.micros("flow.event_time").alias("t_us"),
        F.col("flow.dst_port").cast("long").alias("dst_port"), "flow.duration_ms",
        "flow.packet_count", "flow.byte_count", "flow.state")


@query("src_4_eve_alerts", f"""WITH {B.FLOWS}
SELECT CAST(event_id AS VARCHAR) AS id, t_us, CAST(k + 2100000 AS BIGINT) AS signature_id,
  CASE WHEN event_type = 'error' OR k = 9 THEN 'invalid_record' END AS error_code
FROM flows WHERE event_type IN ('click', 'error')""")
def src_4(spark, sf):
    rows = readers.parse_eve_lines(eve_lines(spark, sf)).where("flow IS NULL")
    got = B.flows(spark, sf).select(B.text("event_id").alias("input_file"), "k", "event_time")
    return rows.join(got, "input_file").select(
        F.col("input_file").alias("id"), B.micros(F.coalesce("signature.event_time", "event_time"))
        .alias("t_us"), F.coalesce("signature.signature_id", F.col("k") + 2_100_000).cast("long")
        .alias("signature_id"), "error_code")


def packets(spark, sf):
    f = B.flows(spark, sf)
    return f.select((F.unix_micros("event_time") / 1_000_000.0).alias("ts"),
                    F.col("src_address").alias("src"),
                    F.when(F.col("k") != 50, F.col("dst_address")).alias("dst"),
                    F.col("src_port").alias("sport"), F.col("dst_port").alias("dport"),
                    F.col("protocol").alias("proto"), F.col("byte_count").alias("length"))


@query("src_5_packets_to_flows", f"""WITH {B.FLOWS},
p AS (SELECT t_us / 1000000.0 AS ts, src_address, dst_address, byte_count,
  CASE WHEN protocol IN ('tcp', 'udp', 'icmp') THEN protocol ELSE 'other' END AS protocol,
  CASE WHEN protocol IN ('tcp', 'udp') THEN src_port END AS src_port,
  CASE WHEN protocol IN ('tcp', 'udp') THEN dst_port END AS dst_port FROM flows WHERE k <> 50)
SELECT src_address, dst_address, CAST(src_port AS BIGINT) AS src_port,
  CAST(dst_port AS BIGINT) AS dst_port, protocol,
  CAST(round_even(min(ts) * 1000000, 0) AS BIGINT) AS t_us,
  CAST(round_even((max(ts) - min(ts)) * 1000, 0) AS BIGINT) AS duration_ms,
  count(*) AS packet_count, CAST(sum(byte_count) AS BIGINT) AS byte_count
FROM p GROUP BY ALL""")
def src_5(spark, sf):
    flows, _ = readers.packets_to_flows(packets(spark, sf))
    return flows.select("src_address", "dst_address", F.col("src_port").cast("long")
                        .alias("src_port"), F.col("dst_port").cast("long").alias("dst_port"),
                        "protocol", B.micros("event_time").alias("t_us"), "duration_ms",
                        "packet_count", "byte_count")


@query("src_5_rejected_packets", f"""WITH {B.FLOWS}
SELECT 'unsupported_packet' AS error_code, count(*) AS n FROM flows WHERE k = 50 HAVING n > 0""")
def src_5_rejects(spark, sf):
    return readers.packets_to_flows(packets(spark, sf))[1].groupBy("error_code").agg(
        F.count(F.lit(1)).alias("n"))


@query("src_6_outcome_counts", f"""WITH {B.EVENTS}
SELECT 'job-' || (event_id % 7) AS job_id,
  count(*) FILTER (WHERE NOT (k % 9 = 0 OR event_id % 7 = 6) AND event_id % 5 <> 0) AS accepted,
  count(*) FILTER (WHERE NOT (k % 9 = 0 OR event_id % 7 = 6) AND event_id % 5 = 0) AS duplicate,
  count(*) FILTER (WHERE k % 9 = 0 OR event_id % 7 = 6) AS rejected,
  CASE WHEN event_id % 7 = 6 THEN 'rejected' ELSE 'succeeded' END AS status,
  CASE WHEN event_id % 7 = 6 THEN 'all_records_rejected' END AS error_code
FROM ev GROUP BY event_id % 7""")
def src_6(spark, sf):
    e = F.col("event_id")
    bad = (F.col("k") % 9 == 0) | (e % 7 == 6)
    return outcomes.job_counts(B.events(spark, sf).select(
        F.concat(F.lit("job-"), (e % 7).cast("string")).alias("job_id"),
        F.when(bad, "invalid_record").alias("error_code"), (e % 5 != 0).alias("is_new")))


@query("src_6_rejects_by_code", f"""WITH {B.FLOWS}
SELECT CASE WHEN event_id % 20 = 2 THEN 'empty_record' WHEN event_id % 20 = 6 THEN 'line_too_long'
  ELSE 'invalid_record' END AS error_code, count(*) AS n
FROM flows WHERE event_id % 20 BETWEEN 1 AND 6 GROUP BY 1""")
def src_6_codes(spark, sf):
    tagged = readers.parse_flow_lines(flow_json_lines(spark, sf))
    path = scratch(spark, "quarantine")
    outcomes.write_quarantine(outcomes.split_outcomes(tagged)[2], path)
    return spark.read.parquet(path).groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


@query("snk_2_flow_lines", f"""WITH {B.FLOWS}
SELECT '{{"byte_count":' || byte_count || ',"dst_address":"' || dst_address || '","dst_port":'
  || coalesce(CAST(dst_port AS VARCHAR), 'null') || ',"duration_ms":' || duration_ms
  || ',"event_time":"' || {Z_TIME} || '","metadata":{{}},"packet_count":' || packet_count
  || ',"protocol":"' || protocol || '","schema_version":"1","source_event_id":"' || event_id
  || '","source_type":"' || source_type || '","src_address":"' || src_address || '","src_port":'
  || coalesce(CAST(src_port AS VARCHAR), 'null') || ',"state":' || {QUOTED.format('state')}
  || '}}' AS value FROM flows""")
def snk_2(spark, sf):
    return sinks.flow_lines(B.flows(spark, sf))


@query("snk_1_feature_files", f"""WITH {B.FLOWS}
SELECT event_key, t_us AS cutoff_us, (SELECT count(*) FROM flows) AS manifest_rows FROM flows""")
def snk_1(spark, sf):
    """The feature table written with its manifest, and read again."""
    path = scratch(spark, "features")
    rows = features.feature_table(B.flows(spark, sf))
    manifest = features.write_features(rows, path).first()
    return spark.read.parquet(path).select(
        "event_key", B.micros("cutoff_time").alias("cutoff_us"),
        F.lit(manifest["row_count"]).alias("manifest_rows"))


@query("snk_2_flow_table", f"""WITH {B.FLOWS}
SELECT event_key, CAST(event_time AS DATE) AS event_date FROM flows""")
def snk_2_table(spark, sf):
    """Flows written by event date and read again."""
    path = scratch(spark, "flows")
    sinks.write_flows(B.flows(spark, sf), path)
    return spark.read.parquet(path).select("event_key", "event_date")


@query("snk_5_table_integrity", """
SELECT l_returnflag, count(*) AS row_count, l_returnflag <> 'R' AS intact FROM lineitem
GROUP BY l_returnflag""")
def snk_5(spark, sf):
    """Line items written in a version where one part was changed, against the manifest of before."""
    path, by = scratch(spark, "integrity"), ["l_returnflag"]
    rows = B.table(spark, sf, "lineitem")
    changed = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") + 1).otherwise(
        F.col("l_quantity"))
    rows.withColumn("l_quantity", changed).write.parquet(path)
    return features.verify(spark.read.parquet(path), D.content_digest(rows, by), by)


@query("agg_19_set_digest", f"""WITH {B.FLOWS},
d AS (SELECT src_address, count(*) AS n, {B.sql_lanes('event_key')} FROM flows
  GROUP BY src_address)
SELECT src_address, n, {B.sql_digest()} AS digest FROM d""")
def agg_19(spark, sf):
    flows = B.flows(spark, sf)
    return D.set_digest(flows.unionByName(flows.where("k % 2 = 0")), "event_key", ["src_address"])
