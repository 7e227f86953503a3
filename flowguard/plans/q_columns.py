"""Contracts, parsing, addresses, notes and identities over whole tables."""

from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.functions import contracts, network, parsing, text
from flowguard.functions.flow_columns import bounded_rate, category, port_class
from flowguard.functions.hashing import canonical_hash, event_key, signature_event_key
from flowguard.plans import bindings as B
from flowguard.plans.registry import query


@query("prj_1_flow_contract", f"""WITH {B.FLOWS}
SELECT event_id, NOT (k IN (11, 12, 13, 14, 15, 16, 17, 18, 19, 20)) AS ok FROM flows""")
def prj_1(spark, sf):
    """Ten values of k break one bound each."""
    k = F.col("k")
    f = B.flows(spark, sf)
    broken = {
        "schema_version": F.when(k == 11, "2").otherwise(F.col("schema_version")),
        "source_type": F.when(k == 12, "other").otherwise(F.col("source_type")),
        "dst_port": F.when(k == 13, 70000).otherwise(F.col("dst_port")),
        "protocol": F.when(k == 14, "TCP!").otherwise(F.col("protocol")),
        "duration_ms": F.when(k == 15, F.lit(604_800_001)).otherwise(F.col("duration_ms")),
        "byte_count": F.when(k == 16, F.lit(-1)).otherwise(F.col("byte_count")),
        "state": F.when(k == 17, "S 0").otherwise(F.col("state")),
        "src_port": F.when(k == 18, F.when(F.col("src_port").isNull(), 1))
        .otherwise(F.col("src_port")),
        "source_event_id": F.when(k == 19, F.repeat(F.lit("x"), 129))
        .otherwise(F.col("source_event_id")),
        "metadata": F.when(k == 20, F.create_map(F.lit("bad-key"), F.lit("v")))
        .otherwise(F.col("metadata")),
    }
    return f.withColumns(broken).select("event_id", contracts.flow_ok().alias("ok"))


@query("prj_2_signature_contract", f"""WITH {B.FLOWS}
SELECT event_id, NOT (k IN (11, 12, 13, 14, 15)) AS ok FROM flows""")
def prj_2(spark, sf):
    k = F.col("k")
    f = B.flows(spark, sf).withColumns({
        "schema_version": F.lit(K.SIGNATURE_SCHEMA_VERSION),
        "signature_id": F.when(k == 11, 0).otherwise(2_100_000),
        "signature_revision": F.when(k == 12, -1).otherwise(1),
        "signature_name": F.when(k == 13, F.lit("a\x00b")).otherwise(F.lit("name\twith tab")),
        "category": F.when(k == 14, F.lit("")).otherwise(F.col("event_type")),
        "reported_severity": F.when(k == 15, 999).otherwise(F.lit(2)),
        "reported_action": F.lit("allowed"), "flow_id": B.text("event_id"),
    })
    return f.select("event_id", contracts.signature_ok().alias("ok"))


@query("prj_3_timestamps", f"""WITH {B.EVENTS}
SELECT event_id, CASE event_id % 6 WHEN 0 THEN (t_us // 1000000) * 1000000 WHEN 1 THEN t_us
  WHEN 2 THEN t_us WHEN 3 THEN NULL WHEN 4 THEN NULL
  ELSE (t_us // 1000000) * 1000000 + 500000 END AS parsed_us
FROM ev""")
def prj_3(spark, sf):
    e = B.events(spark, sf)
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    sec = F.unix_seconds("ts").cast("string")
    which = F.col("event_id") % 6
    raw = (F.when(which == 0, sec).when(which == 1, F.concat(iso, F.lit("Z")))
           .when(which == 2, F.concat(later, F.lit("+02:00"))).when(which == 3, iso)
           .when(which == 4, "abc").otherwise(F.concat(sec, F.lit(".5"))))
    return e.select("event_id", B.micros(parsing.parse_ts(raw)).alias("parsed_us"))


@query("prj_4_numbers", f"""WITH {B.EVENTS}
SELECT event_id, CASE event_id % 6 WHEN 0 THEN k WHEN 3 THEN NULL WHEN 4 THEN NULL
  WHEN 5 THEN k ELSE 0 END::BIGINT AS whole,
  CASE event_id % 6 WHEN 0 THEN k WHEN 3 THEN k + 0.5 WHEN 4 THEN NULL WHEN 5 THEN k ELSE 0 END
    ::DOUBLE AS number FROM ev""")
def prj_4(spark, sf):
    which, k = F.col("event_id") % 6, B.text("k")
    raw = (F.when(which == 0, k).when(which == 1, "-").when(which == 2, "")
           .when(which == 3, F.concat(k, F.lit(".5"))).when(which == 4, "nan")
           .otherwise(F.concat(k, F.lit(".0"))))
    whole, number = parsing.to_int(raw, F.lit(False)), parsing.to_float(raw)
    return B.events(spark, sf).select(
        "event_id", F.when(whole["ok"], whole["value"]).alias("whole"),
        F.when(number["ok"], number["value"]).alias("number"))


@query("prj_5_addresses", f"""WITH {B.EVENTS}
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '10.' || k || '.0.1'
  WHEN 1 THEN '2001:db8::' || lower(to_hex(k + 1)) WHEN 2 THEN NULL WHEN 3 THEN NULL
  ELSE '2001:db8:0:1::' || lower(to_hex(k + 1)) END AS address,
  CASE event_id % 5 WHEN 0 THEN CASE WHEN k >= 0 THEN 'internal' END WHEN 1 THEN 'external'
    WHEN 4 THEN 'external' END AS class FROM ev""")
def prj_5(spark, sf):
    which, k = F.col("event_id") % 5, B.text("k")
    raw = (F.when(which == 0, F.concat(F.lit("10."), k, F.lit(".0.1")))
           .when(which == 1, F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex(F.col("k") + 1)))
           .when(which == 2, F.concat(F.lit("10.0.0.0"), k)).when(which == 3, F.concat(
               F.lit("fe80::"), k, F.lit("::1")))
           .otherwise(F.concat(F.lit("2001:db8:0:1:0:0:0:0"), F.hex(F.col("k") + 1))))
    return B.events(spark, sf).select("event_id", network.canonical_ip(raw).alias("address"),
                                      network.address_class(raw).alias("class"))


@query("prj_7_port_class", f"""WITH {B.FLOWS}
SELECT event_id, CASE WHEN src_port IS NULL THEN 'none' WHEN src_port <= 1023 THEN 'well_known'
    WHEN src_port <= 49151 THEN 'registered' ELSE 'dynamic' END AS src_class,
  CASE WHEN dst_port IS NULL THEN 'none' WHEN dst_port <= 1023 THEN 'well_known'
    WHEN dst_port <= 49151 THEN 'registered' ELSE 'dynamic' END AS dst_class FROM flows""")
def prj_7(spark, sf):
    return B.flows(spark, sf).select("event_id", port_class(F.col("src_port")).alias("src_class"),
                                     port_class(F.col("dst_port")).alias("dst_class"))


@query("prj_8_category_tokens", f"""WITH {B.FLOWS}
SELECT CASE WHEN protocol IN ({B.sql_list(K.PROTOCOL_VOCABULARY)}) THEN protocol
    ELSE '__UNKNOWN__' END AS protocol,
  CASE WHEN state IS NULL THEN '__MISSING__' WHEN state IN ({B.sql_list(K.STATE_VOCABULARY)})
    THEN state ELSE '__UNKNOWN__' END AS state, count(*) AS n FROM flows GROUP BY 1, 2""")
def prj_8(spark, sf):
    return B.flows(spark, sf).groupBy(
        category(F.col("protocol"), K.PROTOCOL_VOCABULARY).alias("protocol"),
        category(F.col("state"), K.STATE_VOCABULARY).alias("state")).agg(
        F.count(F.lit(1)).alias("n"))


@query("prj_9_bounded_rates", f"""WITH {B.FLOWS}
SELECT event_id, CAST(floor(CASE WHEN packet_count = 0 THEN 0 ELSE least(
  byte_count::DOUBLE * 1000000000 / packet_count, 1000000000000.0) END) AS BIGINT) AS rate,
  packet_count > 0 AND byte_count::DOUBLE * 1000000000 / packet_count > 1000000000000.0 AS clipped
FROM flows""")
def prj_9(spark, sf):
    from flowguard.functions.flow_columns import raw_rate
    top = F.col("byte_count").cast("double") * 1_000_000_000
    return B.flows(spark, sf).select(
        "event_id", F.floor(bounded_rate(top, F.col("packet_count"))).cast("long").alias("rate"),
        (raw_rate(top, F.col("packet_count")) > K.RATE_CAP).alias("clipped"))


@query("prj_11_canonical_hash", f"""WITH {B.FLOWS}
SELECT event_id, sha256('{{"bytes":' || byte_count || ',"sensor":'
  || coalesce('"' || sensor_id || '"', 'null') || ',"source":"' || src_address || '"}}') AS hash
FROM flows""")
def prj_11(spark, sf):
    return B.flows(spark, sf).select("event_id", canonical_hash(
        source=F.col("src_address"), bytes=F.col("byte_count"), sensor=F.col("sensor_id"))
        .alias("hash"))


QUOTED = """coalesce('"' || {0} || '"', 'null')"""
Z_TIME = "strftime(event_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN t_us % 1000000 = 0 THEN '' " \
         "ELSE '.' || lpad(CAST(t_us % 1000000 AS VARCHAR), 6, '0') END || 'Z'"


@query("prj_12_event_key", f"""WITH {B.FLOWS}
SELECT event_id, sha256('{{"byte_count":' || byte_count || ',"dst_address":"' || dst_address
  || '","dst_port":' || coalesce(CAST(dst_port AS VARCHAR), 'null') || ',"duration_ms":'
  || duration_ms || ',"event_time":"' || {Z_TIME} || '","metadata":{{}},"packet_count":'
  || packet_count || ',"protocol":"' || protocol || '","schema_version":"1","sensor_id":'
  || {QUOTED.format('sensor_id')} || ',"source_event_id":"' || event_id || '","source_type":"'
  || source_type || '","src_address":"' || src_address || '","src_port":'
  || coalesce(CAST(src_port AS VARCHAR), 'null') || ',"state":' || {QUOTED.format('state')}
  || '}}') AS identity FROM flows""")
def prj_12(spark, sf):
    return B.flows(spark, sf).select("event_id", event_key().alias("identity"))


@query("prj_12_signature_key", f"""WITH {B.FLOWS}
SELECT event_id, sha256('{{"category":"' || event_type || '","dst_address":"' || dst_address
  || '","dst_port":' || coalesce(CAST(dst_port AS VARCHAR), 'null') || ',"event_time":"' || {Z_TIME}
  || '","flow_id":null,"protocol":"' || protocol || '","reported_action":"allowed"'
  || ',"reported_severity":2,"schema_version":"signature-event/v1","sensor_id":'
  || {QUOTED.format('sensor_id')} || ',"signature_id":' || (k + 2100000)
  || ',"signature_name":"seen","signature_revision":1,"source_event_id":"' || event_id
  || '","source_type":"suricata","src_address":"' || src_address || '","src_port":'
  || coalesce(CAST(src_port AS VARCHAR), 'null') || '}}') AS identity FROM flows""")
def prj_12_signature(spark, sf):
    f = B.flows(spark, sf).withColumns({
        "schema_version": F.lit(K.SIGNATURE_SCHEMA_VERSION), "source_type": F.lit("suricata"),
        "signature_id": F.col("k") + 2_100_000, "signature_revision": F.lit(1),
        "signature_name": F.lit("seen"), "category": F.col("event_type"),
        "reported_severity": F.lit(2), "reported_action": F.lit("allowed"),
        "flow_id": F.lit(None).cast("string")})
    return f.select("event_id", signature_event_key().alias("identity"))


@query("prj_13_indicator_values", f"""
SELECT page_id, {B.URL_NORMAL.format('url')} AS url,
  lower(regexp_extract(url, '^[A-Za-z]+://([^:/?#]*)', 1)) AS domain, '192.0.2.' || (page_id % 256)
    AS ipv4, CASE WHEN page_id % 2 = 0 THEN sha256(url) END AS digest FROM pages""")
def prj_13(spark, sf):
    n = lambda kind, c: text.normalize_indicator(F.lit(kind), c)
    host = F.concat(F.upper(F.regexp_extract("url", "^[A-Za-z]+://([^:/?#]*)", 1)), F.lit(".."))
    digest = F.upper(F.sha2("url", 256))
    odd = F.col("page_id") % 2 == 1
    return B.table(spark, sf, "pages").select(
        "page_id", n("url", F.concat(F.lit(" "), F.col("url"), F.lit("  "))).alias("url"),
        n("domain", host).alias("domain"),
        n("ipv4", F.concat(F.lit("192.0.2."), (F.col("page_id") % 256).cast("string")))
        .alias("ipv4"),
        n("sha256", F.when(odd, F.concat(digest, F.lit("0"))).otherwise(digest)).alias("digest"))


@query("prj_14_indicator_hash", f"""
SELECT page_id, sha256('url:' || {B.URL_NORMAL.format('url')}) AS value_hash FROM pages""")
def prj_14(spark, sf):
    return B.table(spark, sf, "pages").select(
        "page_id", text.indicator_hash(F.lit("url"), F.col("url")).alias("value_hash"))


NOTE = "text || ' seen at 192.0.2.' || turn || ' and fe80::' || turn || ':1 '"


@query("prj_15_notes", f"""
WITH n AS (SELECT conv_id, turn, trim({NOTE}) AS body FROM conversations)
SELECT conv_id, turn, CASE WHEN octet_length(encode(body)) <= 4096 THEN sha256(regexp_replace(
    regexp_replace(body, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b', '[redacted-endpoint]', 'g'),
    '\\b[0-9a-fA-F]{{0,4}}(?::[0-9a-fA-F]{{0,4}}){{2,7}}\\b', '[redacted-endpoint]', 'g')) END
    AS body_hash,
  CASE WHEN octet_length(encode(body)) > 4096 THEN 'note_too_large' END AS error FROM n""")
def prj_15(spark, sf):
    c = B.table(spark, sf, "conversations")
    turn = B.text("turn")
    raw = F.concat(F.col("text"), F.lit("\x07 seen at 192.0.2."), turn, F.lit(" and fe80::"), turn,
                   F.lit(":1 "))
    note = text.sanitize_note(raw)
    return c.select("conv_id", "turn", F.sha2(note["body"], 256).alias("body_hash"),
                    note["error"].alias("error"))


@query("prj_16_targets", f"""WITH {B.REQUESTS}
SELECT request_id, CASE target_type WHEN 'internal_ip' THEN 'internal'
    WHEN 'shell_command' THEN 'unknown' ELSE 'external' END AS scope,
  request_id % 6 NOT IN (4, 5) AS valid FROM requests""")
def prj_16(spark, sf):
    kind, value = F.col("target_type"), F.col("target_value")
    return B.requests(spark, sf).select(
        "request_id", network.target_scope(kind).alias("scope"),
        network.is_valid_target(kind, value).alias("valid"))


@query("prj_18_indicator_contract", """
SELECT s_suppkey AS indicator_id, NOT (s_suppkey % 10 IN (3, 5, 7)) AS ok FROM supplier""")
def prj_18(spark, sf):
    key = F.col("s_suppkey")
    base = F.lit(B.utc(1998, 6, 1))
    day = F.make_dt_interval
    rows = B.table(spark, sf, "supplier").select(
        key.alias("indicator_id"), base.alias("first_seen"),
        (base + day(F.when(key % 10 == 3, -1).otherwise(5))).alias("last_seen"),
        (base + day(F.when(key % 10 == 5, 0).otherwise(9))).alias("expires_at"),
        F.when(key % 10 == 7, 1.5).otherwise(0.5).alias("confidence"),
        F.sha2("s_name", 256).alias("value_hash"), F.lit("feed_a").alias("source_name"))
    return rows.select("indicator_id", contracts.indicator_ok().alias("ok"))


@query("prj_19_observability_contract", """
SELECT o_orderkey AS event_id, o_orderkey % 9 NOT IN (2, 4, 6) AND (o_totalprice <= 300000) AS ok
FROM orders""")
def prj_19(spark, sf):
    key = F.col("o_orderkey")
    failed = F.col("o_orderstatus") == "P"
    rows = B.table(spark, sf, "orders").select(
        key.alias("event_id"), F.when(key % 9 == 2, "lost").when(failed, "failed")
        .otherwise("succeeded").alias("status"),
        F.when(key % 9 == 4, F.when(~failed, "odd")).when(failed, "broken").alias("error_code"),
        F.when(key % 9 == 6, "UPPER").otherwise("worker").alias("component"),
        F.lit("job.run").alias("operation"), F.col("o_totalprice").alias("duration_ms"),
        F.lit(1).alias("rows"), F.lit(1).alias("groups"), F.lit(1).alias("tasks"),
        F.lit(1).alias("bytes"))
    return rows.select("event_id", contracts.observability_ok().alias("ok"))
