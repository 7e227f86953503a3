"""Direct features, trailing windows, the feature table and the model matrix."""

from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.operators import features as FT
from flowguard.operators.windows import window_features
from flowguard.plans import bindings as B
from flowguard.plans.registry import query

# Events are sparse, so windows are an hour and a day; 60 s and 300 s are the default.
WINDOWS = (3600, 86400)

RATE_SQL = {
    "bytes_per_packet": ("byte_count", "packet_count"),
    "packets_per_second": ("packet_count", "(duration_ms / 1000.0::DOUBLE)"),
    "bytes_per_second": ("byte_count", "(duration_ms / 1000.0::DOUBLE)"),
}


def rate_sql(name):
    a, b = RATE_SQL[name]
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE least({a} / {b}::DOUBLE, 1e12) END"


def class_sql(c):
    return (f"CASE WHEN {c} IS NULL THEN 'none' WHEN {c} <= 1023 THEN 'well_known' "
            f"WHEN {c} <= 49151 THEN 'registered' ELSE 'dynamic' END")


DIRECT_SQL = {
    "duration_ms": "duration_ms", "packet_count": "packet_count", "byte_count": "byte_count",
    "src_port_present": "src_port IS NOT NULL", "dst_port_present": "dst_port IS NOT NULL",
    "src_port": "CAST(coalesce(src_port, 0) AS BIGINT)",
    "dst_port": "CAST(coalesce(dst_port, 0) AS BIGINT)",
    "src_port_class": class_sql("src_port"), "dst_port_class": class_sql("dst_port"),
    "protocol": f"CASE WHEN protocol IN ({B.sql_list(K.PROTOCOL_VOCABULARY)}) THEN protocol "
                "ELSE '__UNKNOWN__' END",
    "connection_state": "CASE WHEN state IS NULL THEN '__MISSING__' WHEN state IN "
                        f"({B.sql_list(K.STATE_VOCABULARY)}) THEN state ELSE '__UNKNOWN__' END",
    **{n: rate_sql(n) for n in RATE_SQL},
    "zero_duration": "duration_ms = 0", "zero_packets": "packet_count = 0",
    "rate_clipped": "FALSE",
}
DOUBLES = set(RATE_SQL)


def rounded(names):
    """Columns with doubles rounded, for comparison."""
    wide = lambda n: n in DOUBLES or n.endswith(("mean_duration_ms", "mean_bytes_per_flow",
                                                  "seconds_since_prior_service"))
    return [F.round(n, 6).alias(n) if wide(n) else F.col(n) for n in names]


def direct_sql(names=K.DIRECT_FEATURES):
    return ", ".join((f"round({DIRECT_SQL[n]}, 6)" if n in DOUBLES else DIRECT_SQL[n])
                     + f" AS {n}" for n in names)


@query("prj_6_direct_features", f"WITH {B.FLOWS} SELECT event_key, {direct_sql()} FROM flows")
def prj_6(spark, sf):
    return FT.direct_features(B.flows(spark, sf)).select("event_key", *rounded(K.DIRECT_FEATURES))


WINDOW_SQL = {
    "flow_count": "count(*)", "unique_dst_address_count": "count(DISTINCT c.dst_address)",
    "unique_dst_port_count": "count(DISTINCT c.dst_port)",
    "packet_total": "CAST(sum(c.packet_count) AS BIGINT)",
    "byte_total": "CAST(sum(c.byte_count) AS BIGINT)",
    "failure_count": "count(*) FILTER (WHERE c.failed)",
    "mean_duration_ms": "round(avg(c.duration_ms), 6)",
    "max_duration_ms": "max(c.duration_ms)",
    "mean_bytes_per_flow": "round(avg(c.byte_count), 6)",
    "seconds_since_prior_service": f"round(coalesce((t.t_us - max(c.t_us) FILTER (WHERE {{0}})) "
                                   "/ 1000000.0, 0), 6)",
    "prior_service_missing": "count(*) FILTER (WHERE {0}) = 0",
}
SAME = ("c.event_key <> t.event_key AND c.dst_address = t.dst_address AND "
        "c.dst_port IS NOT DISTINCT FROM t.dst_port AND c.protocol = t.protocol")


def window_cte(seconds, names):
    """All flows against the flows of their trailing window, by self-join."""
    items = ", ".join(f"{WINDOW_SQL[n].replace('{0}', SAME)} AS w{seconds}_{n}" for n in names)
    return f"""w{seconds} AS (SELECT t.event_key, {items} FROM flows t JOIN flows c
  ON c.sensor_id IS NOT DISTINCT FROM t.sensor_id AND c.src_address = t.src_address
  AND c.t_us >= t.t_us - {seconds * 1_000_000} AND (c.t_us, c.event_key) <= (t.t_us, t.event_key)
  GROUP BY t.event_key, t.t_us)"""


def window_sql(names, windows=WINDOWS):
    ctes = ", ".join(window_cte(w, names) for w in windows)
    joins = " JOIN ".join([f"w{windows[0]}", *[f"w{w} USING (event_key)" for w in windows[1:]]])
    cols = ", ".join(f"w{w}_{n}" for w in windows for n in names)
    return f"WITH {B.FLOWS}, {ctes} SELECT event_key, {cols} FROM {joins}"


FEATURES_BY_ID = {
    "win_1_flow_count": ["flow_count"],
    "win_2_unique_dst_address": ["unique_dst_address_count"],
    "win_3_unique_dst_port": ["unique_dst_port_count"],
    "win_4_totals": ["packet_total", "byte_total"],
    "win_5_failure_count": ["failure_count"],
    "win_6_mean_duration": ["mean_duration_ms"],
    "win_7_max_duration": ["max_duration_ms"],
    "win_8_mean_bytes": ["mean_bytes_per_flow"],
    "win_9_prior_missing": ["prior_service_missing"],
    "win_10_since_prior": ["seconds_since_prior_service"],
}


def _window_query(key, names):
    @query(key, window_sql(names))
    def run(spark, sf):
        cols = [f"w{w}_{n}" for w in WINDOWS for n in names]
        return window_features(B.flows(spark, sf), WINDOWS).select("event_key", *rounded(cols))
    return run


for _key, _names in FEATURES_BY_ID.items():
    _window_query(_key, _names)


def table_sql(windows, extra=""):
    names = K.WINDOW_FEATURES
    ctes = ", ".join(window_cte(w, names) for w in windows)
    joins = " ".join(f"JOIN w{w} USING (event_key)" for w in windows)
    cols = ", ".join(f"w{w}_{n}" for w in windows for n in names)
    return ctes, joins, cols


_CTES, _JOINS, _COLS = table_sql(WINDOWS)


@query("win_11_feature_table", f"""WITH {B.FLOWS}, {_CTES},
pair AS (SELECT event_key || '|' || coalesce(sensor_id, '') AS p FROM flows),
snap AS (SELECT count(*) AS n, {B.sql_lanes('p')} FROM pair)
SELECT event_key, t_us AS cutoff_us, '{FT.schema_hash(WINDOWS)}' AS schema_hash,
  '1.0.0' AS schema_version, (SELECT {B.sql_digest()} FROM snap) AS snapshot_hash,
  '' AS quality_flags, {direct_sql()}, {_COLS} FROM flows {_JOINS}""")
def win_11(spark, sf):
    names = K.feature_names(WINDOWS)
    return FT.feature_table(B.flows(spark, sf), WINDOWS).select(
        "event_key", B.micros("cutoff_time").alias("cutoff_us"), "schema_hash",
        "schema_version", "snapshot_hash",
        F.concat_ws(",", "quality_flags").alias("quality_flags"), *rounded(names))


@query("snk_4_model_matrix", "WITH {0}, {1} SELECT {2}, {3} FROM flows {4}".format(
    B.FLOWS, table_sql(K.DEFAULT_WINDOWS)[0], direct_sql(), table_sql(K.DEFAULT_WINDOWS)[2],
    table_sql(K.DEFAULT_WINDOWS)[1]))
def snk_4(spark, sf):
    return FT.model_matrix(FT.feature_table(B.flows(spark, sf))).select(
        *rounded(K.feature_names()))


TEXT_SQL = " || '|' || ".join(
    f"CAST(CAST({DIRECT_SQL[n]} AS DECIMAL(38,6)) AS VARCHAR)" if n in DOUBLES
    else f"CAST({DIRECT_SQL[n]} AS VARCHAR)" for n in K.DIRECT_FEATURES)


@query("ml_15_near_key", f"""WITH {B.FLOWS}
SELECT event_key, sha256({TEXT_SQL}) AS near FROM flows""")
def ml_15(spark, sf):
    direct = FT.direct_features(B.flows(spark, sf))
    return direct.select("event_key", FT.near_key(direct, K.DIRECT_FEATURES).alias("near"))


@query("agg_11_quality_flags", f"""WITH {B.FLOWS}
SELECT flag, count(*) AS n FROM (
  SELECT 'bytes_per_packet_clipped' AS flag FROM flows
    WHERE packet_count > 0 AND byte_count * 100000000000.0 / packet_count > 1e12
  UNION ALL SELECT 'bytes_per_second_clipped' FROM flows
    WHERE duration_ms > 0 AND byte_count * 100000000000.0 / (duration_ms / 1000.0) > 1e12)
GROUP BY flag""")
def agg_11_flags(spark, sf):
    from flowguard.operators.splits import counts_by
    loud = B.flows(spark, sf).withColumn("byte_count", F.col("byte_count") * 100_000_000_000)
    return counts_by(FT.direct_features(loud), ["quality_flags"]).select(
        F.col("value").alias("flag"), "n")
