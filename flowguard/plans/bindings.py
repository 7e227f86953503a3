"""How the given tables stand in for the engine's tables, for Spark and for SQL.

``events`` plays the flows, ``orders`` jobs, runs and action requests, ``lineitem``
metric rows, ``customer`` alerts, ``nation`` incidents, ``supplier`` and ``pages``
indicators, ``conversations`` notes. The SQL texts are common table expressions that
give DuckDB the same rows.
"""

from datetime import datetime, timezone
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowguard import constants as K
from flowguard.functions.hashing import LANES, LANE_HEX
from flowguard.operators.rules import RuleSpec
from flowguard.session import pin_utc

DAY = 86_400
DAY_US = DAY * 1_000_000


def utc(*parts) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


EVENTS_NOW = utc(2024, 1, 20)
ORDERS_NOW = utc(1998, 8, 2)

# Events are sparse, so rules use day buckets and small thresholds.
RULES = (
    RuleSpec("behavior.port_scan", "port_scan_v1", "reconnaissance", "medium", DAY, 3),
    RuleSpec("behavior.repeated_failure", "repeated_failure_v1", "connection_failure", "low", DAY,
             2, K.FAILURE_STATES),
    RuleSpec("behavior.high_connection_rate", "high_connection_rate_v1", "traffic_rate",
             "medium", DAY, 3),
)
SCAN, FAILURE, RATE = RULES


_PLANS: dict = {}


def shared_plan(make):
    """Build a binding's plan once per session and folder. Only the plan is kept, no data."""
    @wraps(make)
    def get(spark, sf, *args):
        key = (make.__name__, sf, *args)
        held = _PLANS.get(key)
        if held is None or held[0] is not spark:
            held = _PLANS[key] = (spark, make(spark, sf, *args))
        return held[1]
    return get


@shared_plan
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One given table; times without a zone are taken as UTC."""
    df = pin_utc(spark).read.parquet(f"{sf}/{name}.parquet")
    for field in df.schema:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def micros(c) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def text(c) -> Column:
    return F.col(c).cast("string")


def number_in_props() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", number_in_props())


EVENTS = """
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, epoch_us(ts) AS t_us
       FROM events)"""


def flow_columns() -> dict:
    kind, user, k, eid = F.col("event_type"), F.col("user_id"), F.col("k"), F.col("event_id")
    signup = kind == "signup"
    return {
        "event_key": F.sha2(F.concat(F.lit("evt|"), text("event_id")), 256),
        "event_time": F.col("ts"),
        "sensor_id": F.when(user % 4 != 3, F.concat(F.lit("sensor-"), (user % 4).cast("string"))),
        "src_address": F.concat(F.lit("192.0.2."), (user % 16 + 1).cast("string")),
        "dst_address": F.concat(F.lit("198.51.100."), (k % 4 + 1).cast("string")),
        "src_port": F.when(~signup, (F.lit(40000) + eid % 20000).cast("int")),
        "dst_port": F.when(~signup, (F.lit(1000) + F.floor(k / 4) % 10).cast("int")),
        "protocol": F.when(signup, "icmp").when(kind == "view", "udp").when(kind == "click", "sctp")
        .otherwise("tcp"),
        "source_type": F.when(kind.isin("error", "click"), "zeek").otherwise("normalized"),
        "state": F.when(kind == "error", F.element_at(F.array(*[
            F.lit(s) for s in ("REJ", "S0", "RSTO", "RSTR")]), (k % 4 + 1).cast("int")))
        .when(kind == "click", "WEIRD").when(kind != "view", "SF"),
        "duration_ms": F.floor(F.col("value") * 10).cast("long"),
        "packet_count": k.cast("long"),
        "byte_count": F.floor(F.col("value") * 100).cast("long"),
        "schema_version": F.lit("1"),
        "source_event_id": text("event_id"),
        "metadata": F.create_map().cast("map<string,string>"),
        "job_id": F.when(eid % 10 < 8, "job-old").otherwise("job-new"),
        "ingested_at": F.col("ts") + F.make_dt_interval((eid % 5).cast("int")),
    }


@shared_plan
def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as canonical flows, with event_id, user_id, k and event_type kept."""
    return events(spark, sf).select("event_id", "user_id", "k", "event_type", "value",
                                    *[c.alias(n) for n, c in flow_columns().items()])


FLOWS = EVENTS + f""",
flows AS (
  SELECT event_id, user_id, k, event_type, value, t_us,
    sha256('evt|' || event_id) AS event_key, ts AS event_time,
    CASE WHEN user_id % 4 <> 3 THEN 'sensor-' || (user_id % 4) END AS sensor_id,
    '192.0.2.' || (user_id % 16 + 1) AS src_address,
    '198.51.100.' || (k % 4 + 1) AS dst_address,
    CASE WHEN event_type <> 'signup' THEN CAST(40000 + event_id % 20000 AS INT) END AS src_port,
    CASE WHEN event_type <> 'signup' THEN CAST(1000 + (k // 4) % 10 AS INT) END AS dst_port,
    CASE event_type WHEN 'signup' THEN 'icmp' WHEN 'view' THEN 'udp' WHEN 'click' THEN 'sctp'
      ELSE 'tcp' END AS protocol,
    CASE WHEN event_type IN ('error', 'click') THEN 'zeek' ELSE 'normalized' END AS source_type,
    CASE event_type WHEN 'error' THEN ['REJ', 'S0', 'RSTO', 'RSTR'][k % 4 + 1]
      WHEN 'click' THEN 'WEIRD' WHEN 'view' THEN NULL ELSE 'SF' END AS state,
    CAST(floor(value * 10) AS BIGINT) AS duration_ms, CAST(k AS BIGINT) AS packet_count,
    CAST(floor(value * 100) AS BIGINT) AS byte_count,
    CASE WHEN event_id % 10 < 8 THEN 'job-old' ELSE 'job-new' END AS job_id,
    ts + to_days(CAST(event_id % 5 AS INT)) AS ingested_at,
    (t_us // {DAY_US}) * {DAY_US} AS bucket_us,
    event_type = 'error' AS failed
  FROM ev)"""


def sql_lanes(key: str) -> str:
    """Sums over the hash lanes of a key, as SQL select items."""
    return ", ".join(
        f"sum(CAST('0x' || substr(sha256({key}), {1 + LANE_HEX * i}, {LANE_HEX}) AS BIGINT))"
        f" AS lane{i}" for i in range(LANES))


def sql_digest(count: str = "n", lane: str = "lane") -> str:
    parts = " || '|' || ".join(f"CAST({lane}{i} AS VARCHAR)" for i in range(LANES))
    return f"sha256(CAST({count} AS VARCHAR) || '|' || {parts})"


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def old_flows(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).where("job_id = 'job-old'")


def new_flows(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).where("job_id = 'job-new'")


# --- matches, signals and alerts as SQL ------------------------------------

def sql_matches(source: str = "flows", name: str = "matches") -> str:
    """The three rules over a flow table, as a common table expression."""
    def part(rule, keys, observed, where):
        null = {"dst_address": "NULL", "dst_port": "CAST(NULL AS INT)", "protocol": "NULL"}
        cols = ", ".join(c if c in keys else f"{null[c]} AS {c}" for c in null)
        by = ", ".join(["bucket_us", "sensor_id", *keys])
        return f"""
  SELECT '{rule.rule_key}' AS rule_key, '{rule.category}' AS category,
    '{rule.severity}' AS severity, bucket_us, sensor_id, src_address, {cols},
    {observed} AS observed_value, {rule.threshold} AS threshold_value, count(*) AS n,
    {sql_lanes('event_key')}
  FROM {source} WHERE {where} GROUP BY {by} HAVING {observed} >= {rule.threshold}"""
    return f"""{name} AS (
  {part(SCAN, ['src_address', 'dst_address'], 'count(DISTINCT dst_port)', 'dst_port IS NOT NULL')}
  UNION ALL
  {part(FAILURE, ['src_address', 'dst_address', 'dst_port', 'protocol'], 'count(*)',
        'failed AND dst_port IS NOT NULL')}
  UNION ALL
  {part(RATE, ['src_address'], 'count(*)', 'TRUE')})"""


ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
GROUP_JSON = """'{' || CASE WHEN dst_address IS NULL THEN ''
        ELSE '"dst_address":"' || dst_address || '",' END
      || CASE WHEN dst_port IS NULL THEN '' ELSE '"dst_port":"' || dst_port || '",' END
      || CASE WHEN protocol IS NULL THEN '' ELSE '"protocol":"' || protocol || '",' END
      || '"sensor_id":"' || coalesce(sensor_id, 'unspecified')
      || '","src_address":"' || src_address || '"}'"""


def sql_signals(matches: str = "matches", name: str = "signals") -> str:
    """Signals with series and semantic key, and the alert fingerprint."""
    return f"""{name}_0 AS (
  SELECT *, {sql_digest()} AS evidence_digest, {GROUP_JSON} AS grouping FROM {matches}),
{name}_1 AS (
  SELECT *, sha256('{{"bucket_start":"' || {ISO.format('bucket_us')} || '","group":' || grouping
    || ',"rule_key":"' || rule_key || '","rule_version_id":"1","source_type":"behavioral_rule"'
    || ',"window_seconds":{DAY}}}') AS series_key FROM {name}_0),
{name} AS (
  SELECT *, sha256('{{"evidence":"' || evidence_digest || '","series":"' || series_key || '"}}')
      AS semantic_key,
    sha256('{{"fingerprint_schema":"{K.ALERT_FINGERPRINT_SCHEMA}","series_key":"' || series_key
      || '"}}') AS fingerprint,
    bucket_us + {DAY_US} AS bucket_end_us FROM {name}_1)"""


# Signals of the old job, and of everything; alerts made of the latter.
SIGNALS = f"""{FLOWS},
old_flows AS (SELECT * FROM flows WHERE job_id = 'job-old'),
{sql_matches('flows', 'matches')},
{sql_matches('old_flows', 'old_matches')},
{sql_signals('matches', 'signals')},
{sql_signals('old_matches', 'old_signals')}"""

MERGED_ALERTS = f"""{SIGNALS},
current_alerts AS (
  SELECT fingerprint, category, severity, sensor_id, grouping, count(*) AS occurrence_count,
    min(bucket_us) AS first_us, max(bucket_end_us) AS last_us FROM old_signals
  GROUP BY ALL),
novel AS (SELECT * FROM signals WHERE semantic_key NOT IN (SELECT semantic_key FROM old_signals)),
alerts AS (
  SELECT fingerprint, category, severity, sensor_id, grouping, sum(n) AS occurrence_count,
    min(first_us) AS first_us, max(last_us) AS last_us
  FROM (SELECT fingerprint, category, severity, sensor_id, grouping, occurrence_count AS n,
          first_us, last_us FROM current_alerts
        UNION ALL
        SELECT fingerprint, category, severity, sensor_id, grouping, 1, bucket_us, bucket_end_us
        FROM novel)
  GROUP BY fingerprint, category, severity, sensor_id, grouping)"""


@shared_plan
def all_signals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(signals over all flows, signals over the old job's flows)."""
    from flowguard.operators.rules import evaluate_rules
    from flowguard.operators.signals import with_signal_keys
    return (with_signal_keys(evaluate_rules(flows(spark, sf), RULES, unique=True)),
            with_signal_keys(evaluate_rules(old_flows(spark, sf), RULES, unique=True)))


@shared_plan
def merged_alerts(spark: SparkSession, sf: str) -> DataFrame:
    from flowguard.operators.alerts import rollup_alerts
    from flowguard.operators.signals import novel_signals
    now, before = all_signals(spark, sf)
    return rollup_alerts(novel_signals(now, before), rollup_alerts(before))


# --- policy tables -----------------------------------------------------------

@shared_plan
def assets(spark: SparkSession, sf: str) -> DataFrame:
    """One asset per source seen, numbered by its last octet."""
    n = F.element_at(F.split("src_address", "\\."), -1).cast("int")
    return (flows(spark, sf).select("src_address").distinct()
            .select(F.concat(F.lit("asset-"), n.cast("string")).alias("asset_id"),
                    F.when(n != 5, F.col("src_address")).alias("address"),
                    F.when(n % 4 == 0, "critical").otherwise("low").alias("criticality"),
                    (n % 3 != 0).alias("is_active")))


ASSETS = """
assets AS (
  SELECT 'asset-' || n AS asset_id, CASE WHEN n <> 5 THEN src_address END AS address,
    CASE WHEN n % 4 = 0 THEN 'critical' ELSE 'low' END AS criticality, n % 3 <> 0 AS is_active
  FROM (SELECT DISTINCT src_address, CAST(split_part(src_address, '.', 4) AS INT) AS n
        FROM flows))"""


@shared_plan
def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as action requests."""
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    which = key % 6
    s = lambda c: c.cast("string")
    kind = F.when(which == 2, "internal_ip").when(which == 3, "external_domain") \
        .when(which == 5, "shell_command").otherwise("external_ip")
    value = (F.when(which == 0, F.concat(F.lit("203.0.113."), s(cust % 250 + 1)))
             .when(which == 1, F.concat(F.lit("192.0.2."), s(cust % 16 + 1)))
             .when(which == 2, F.concat(F.lit("10.0."), s(cust % 250), F.lit(".7")))
             .when(which == 3, F.concat(F.lit("host-"), s(cust), F.lit(".example.com")))
             .when(which == 4, F.concat(F.lit("300.1.1."), s(cust % 250)))
             .otherwise(F.concat(F.lit("run-"), s(cust))))
    return o.select(
        key.alias("request_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderpriority").startswith("1"), "temporary_block")
        .otherwise("temporary_rate_limit").alias("action_type"),
        kind.alias("target_type"), value.alias("target_value"),
        F.when(F.col("o_orderstatus") == "F", "simulated").when(F.col("o_orderstatus") == "P",
                                                                "rejected")
        .otherwise("draft").alias("status"),
        F.when(key % 3 != 0, cust).alias("alert_id"),
        F.when(key % 2 == 0, (key % 30).cast("int")).alias("incident_id"),
        F.when(key % 5 == 0, key % 150).alias("indicator_id"),
        ((key % 7) * 20_000).alias("duration_seconds"),
        (key % 11 != 0).alias("has_expiry"), (key % 13 != 0).alias("has_rollback_plan"),
        F.lit(K.SIMULATION_MODE).alias("environment"), (key % 17 != 0).alias("has_permission"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 40).cast("int"))).alias("expires_at"))


REQUESTS = """
requests AS (
  SELECT o_orderkey AS request_id, o_orderdate AS created_at,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'temporary_block' ELSE 'temporary_rate_limit' END
      AS action_type,
    CASE o_orderkey % 6 WHEN 2 THEN 'internal_ip' WHEN 3 THEN 'external_domain'
      WHEN 5 THEN 'shell_command' ELSE 'external_ip' END AS target_type,
    CASE o_orderkey % 6 WHEN 0 THEN '203.0.113.' || (o_custkey % 250 + 1)
      WHEN 1 THEN '192.0.2.' || (o_custkey % 16 + 1) WHEN 2 THEN '10.0.' || (o_custkey % 250) || '.7'
      WHEN 3 THEN 'host-' || o_custkey || '.example.com'
      WHEN 4 THEN '300.1.1.' || (o_custkey % 250) ELSE 'run-' || o_custkey END AS target_value,
    CASE o_orderstatus WHEN 'F' THEN 'simulated' WHEN 'P' THEN 'rejected' ELSE 'draft' END
      AS status,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS alert_id,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 30 END AS incident_id,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 150 END AS indicator_id,
    (o_orderkey % 7) * 20000 AS duration_seconds, o_orderkey % 11 <> 0 AS has_expiry,
    o_orderkey % 13 <> 0 AS has_rollback_plan, o_orderkey % 17 <> 0 AS has_permission,
    o_orderdate + to_days(CAST(o_orderkey % 40 AS INT)) AS expires_at
  FROM orders)"""


@shared_plan
def policy_tables(spark: SparkSession, sf: str) -> dict:
    """Allowlist, alerts, incidents, members and indicators the requests refer to."""
    part, cust = table(spark, sf, "part"), table(spark, sf, "customer")
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    base = F.lit(utc(1998, 6, 1))
    seg = F.col("c_mktsegment")
    return {
        "allow": part.select(
            F.lit("external_domain").alias("target_type"),
            F.concat(F.lit("host-"), text("p_partkey"), F.lit(".example.com"))
            .alias("target_value"),
            F.when(F.col("p_size") >= 10, base + F.make_dt_interval(F.col("p_size") * 2))
            .alias("expires_at")),
        "alerts": cust.select(
            F.col("c_custkey").alias("alert_id"),
            F.when(seg.startswith("A"), "behavioral_rule").when(seg.startswith("B"),
                                                                "suricata_signature")
            .otherwise("anomaly").alias("source_type")),
        "incidents": nation.select(F.col("n_nationkey").alias("incident_id")),
        "members": cust.select(
            F.col("c_nationkey").alias("incident_id"), F.col("c_custkey").alias("alert_id")),
        "indicators": supplier.select(
            F.col("s_suppkey").alias("indicator_id"),
            (base + F.make_dt_interval((F.col("s_suppkey") % 120).cast("int")))
            .alias("expires_at")),
        "assets": assets(spark, sf),
    }


POLICY = FLOWS + "," + ASSETS + "," + REQUESTS + """,
allow AS (
  SELECT 'external_domain' AS target_type, 'host-' || p_partkey || '.example.com' AS target_value,
    CASE WHEN p_size >= 10 THEN TIMESTAMP '1998-06-01' + to_days(p_size * 2) END AS expires_at
  FROM part),
p_alerts AS (
  SELECT c_custkey AS alert_id, CASE WHEN c_mktsegment LIKE 'A%' THEN 'behavioral_rule'
    WHEN c_mktsegment LIKE 'B%' THEN 'suricata_signature' ELSE 'anomaly' END AS source_type
  FROM customer),
incidents AS (SELECT n_nationkey AS incident_id FROM nation),
members AS (SELECT c_nationkey AS incident_id, c_custkey AS alert_id FROM customer),
p_indicators AS (
  SELECT s_suppkey AS indicator_id,
    TIMESTAMP '1998-06-01' + to_days(CAST(s_suppkey % 120 AS INT)) AS expires_at FROM supplier)"""


# --- threat indicators --------------------------------------------------------

@shared_plan
def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of flows and page addresses as observed values."""
    f = flows(spark, sf).select(F.lit("ipv4").alias("indicator_type"),
                                F.col("src_address").alias("raw_value"),
                                F.col("event_key").alias("provenance_hash"))
    p = table(spark, sf, "pages").select(
        F.lit("url").alias("indicator_type"), F.col("url").alias("raw_value"),
        F.sha2(F.concat(F.lit("page|"), text("page_id")), 256).alias("provenance_hash"))
    return f.unionByName(p)


@shared_plan
def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of every fifth user, twice over, and every fourth page address."""
    from flowguard.functions.text import indicator_hash
    f = flows(spark, sf).where("user_id % 5 = 0").groupBy("src_address").agg(
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    feeds = F.explode(F.array(F.lit("feed_a"), F.lit("feed_b")))
    ip = f.select(F.lit("ipv4").alias("indicator_type"), F.col("src_address").alias("raw"),
                  feeds.alias("source_name"), "first_seen", "last_seen") \
        .withColumn("expires_at", F.when(F.col("source_name") == "feed_a", F.col("last_seen"))
                    .otherwise(F.col("first_seen") + F.expr("INTERVAL 10 DAYS")))
    url = table(spark, sf, "pages").where("page_id % 4 = 0").select(
        F.lit("url").alias("indicator_type"), F.concat("url", F.lit("#x")).alias("raw"),
        F.lit("feed_u").alias("source_name"), F.lit(utc(2024, 1, 1)).alias("first_seen"),
        F.lit(utc(2024, 1, 2)).alias("last_seen"),
        (F.lit(utc(2024, 1, 10)) + F.make_dt_interval((F.col("page_id") % 20).cast("int")))
        .alias("expires_at"))
    rows = ip.unionByName(url).withColumn("value_hash", indicator_hash(
        F.col("indicator_type"), F.col("raw"))).where("value_hash IS NOT NULL")
    return (rows.withColumn("indicator_hash", F.sha2(F.concat_ws(
        "|", "indicator_type", "value_hash", "source_name"), 256)).drop("raw"))


URL_NORMAL = r"""CASE WHEN regexp_matches({0}, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#:]+') THEN
  lower(regexp_extract({0}, '^([A-Za-z]+)://', 1)) || '://'
  || lower(regexp_extract({0}, '^[A-Za-z]+://([^:/?#]*)', 1))
  || regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END"""

INDICATORS = f"""
observations AS (
  SELECT 'ipv4' AS indicator_type, src_address AS raw_value, event_key AS provenance_hash,
    sha256('ipv4:' || src_address) AS value_hash FROM flows
  UNION ALL
  SELECT 'url', url, sha256('page|' || page_id), sha256('url:' || {URL_NORMAL.format('url')})
  FROM pages),
ind_ip AS (
  SELECT 'ipv4' AS indicator_type, sha256('ipv4:' || src_address) AS value_hash, feed
    AS source_name, min(event_time) AS first_seen, max(event_time) AS last_seen
  FROM flows, (VALUES ('feed_a'), ('feed_b')) AS v(feed) WHERE user_id % 5 = 0
  GROUP BY src_address, feed),
ind_rows AS (
  SELECT *, CASE WHEN source_name = 'feed_a' THEN last_seen
    ELSE first_seen + INTERVAL 10 DAY END AS expires_at FROM ind_ip
  UNION ALL
  SELECT 'url', sha256('url:' || {URL_NORMAL.format('url')}), 'feed_u',
    TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02',
    TIMESTAMP '2024-01-10' + to_days(CAST(page_id % 20 AS INT))
  FROM pages WHERE page_id % 4 = 0),
indicators AS (
  SELECT *, sha256(indicator_type || '|' || value_hash || '|' || source_name) AS indicator_hash
  FROM ind_rows)"""
