"""Splits, leakage checks, encoders, quantiles and score metrics."""

from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.operators import encoders as E, metrics as M, splits as S
from flowguard.operators.ordered import quantiles
from flowguard.plans import bindings as B
from flowguard.plans.registry import query
from flowguard.session import scratch
from flowguard.sources.sinks import write_targets


@B.shared_plan
def split_flows(spark, sf):
    """Flows with label, family and the partition of their user."""
    f = B.flows(spark, sf).withColumns({
        "label": (F.col("event_type") == "error").cast("int"),
        "family": F.col("event_type")})
    return S.group_time_split(f, "user_id", "event_time")


SPLIT = B.FLOWS + """,
grp AS (SELECT user_id, min(t_us) AS start_us, count(*) AS rows FROM flows GROUP BY user_id),
cum AS (SELECT *, sum(rows) OVER (ORDER BY start_us, user_id) AS upto, sum(rows) OVER () AS total
        FROM grp),
parts AS (SELECT user_id, upto, CASE WHEN (upto - rows / 2.0) / total <= 0.7 THEN 'training'
    WHEN (upto - rows / 2.0) / total <= 0.85 THEN 'validation' ELSE 'test' END AS partition
  FROM cum),
sf AS (SELECT flows.*, partition, CAST(event_type = 'error' AS INT) AS label,
    event_type AS family FROM flows JOIN parts USING (user_id))"""


@query("win_12_group_time_split", f"""WITH {SPLIT}
SELECT user_id, partition, CAST(upto AS BIGINT) AS upto FROM parts""")
def win_12(spark, sf):
    shares = S.group_shares(B.flows(spark, sf), "user_id", "event_time")
    named = split_flows(spark, sf).select("user_id", "partition").distinct()
    return named.join(shares.select("user_id", F.col("_upto").alias("upto")), "user_id")


@query("snk_3_target_files", f"""WITH {SPLIT}
SELECT event_key, label, family, user_id AS group_id, partition FROM sf""")
def snk_3(spark, sf):
    """Targets written apart from the features, and read again."""
    path = scratch(spark, "targets")
    write_targets(split_flows(spark, sf).withColumn("group_id", F.col("user_id")), path)
    return spark.read.parquet(path)


@query("jn_15_partition_overlap", f"""WITH {SPLIT}
SELECT sha256(dst_address || '|' || coalesce(dst_port, 0) || '|' || protocol) AS key,
  min(partition) AS first_partition, max(partition) AS last_partition, count(*) AS copies
FROM sf GROUP BY 1 HAVING min(partition) <> max(partition)""")
def jn_15(spark, sf):
    key = F.sha2(F.concat_ws("|", "dst_address", F.coalesce("dst_port", F.lit(0)).cast("string"),
                             "protocol"), 256)
    return S.partition_overlap(split_flows(spark, sf), key)


@query("jn_15_group_overlap", f"""WITH {SPLIT}
SELECT CAST(user_id AS VARCHAR) AS key, min(partition) AS first_partition,
  max(partition) AS last_partition, count(*) AS copies
FROM sf GROUP BY 1 HAVING min(partition) <> max(partition)""")
def jn_15_groups(spark, sf):
    return S.partition_overlap(split_flows(spark, sf), B.text("user_id"))


@query("jn_16_attach_labels", f"""WITH {SPLIT}
SELECT event_key, byte_count, label, partition FROM sf""")
def jn_16(spark, sf):
    rows = split_flows(spark, sf)
    return S.attach_labels(rows.select("event_key", "byte_count"),
                           rows.select("event_key", "label", "partition"))


@query("agg_11_split_counts", f"""WITH {SPLIT}
SELECT 'label' AS kind, CAST(label AS VARCHAR) AS value, count(*) AS n FROM sf GROUP BY label
UNION ALL SELECT 'family', family, count(*) FROM sf GROUP BY family
UNION ALL SELECT 'partition', partition, count(*) FROM sf GROUP BY partition""")
def agg_11(spark, sf):
    return S.counts_by(split_flows(spark, sf), ["label", "family", "partition"])


@query("agg_20_perfect_separators", f"""WITH {B.FLOWS},
p AS (SELECT 'protocol' AS feature, protocol AS value, event_type = 'signup' AS label FROM flows
  UNION ALL SELECT 'dst_port', coalesce(CAST(dst_port AS VARCHAR), ''), event_type = 'signup'
    FROM flows
  UNION ALL SELECT 'packet_count', CAST(packet_count AS VARCHAR), event_type = 'signup' FROM flows),
v AS (SELECT feature, value, min(label) <> max(label) AS mixed FROM p GROUP BY 1, 2)
SELECT feature, count(*) AS values FROM v GROUP BY feature HAVING NOT bool_or(mixed)""")
def agg_20(spark, sf):
    f = B.flows(spark, sf).withColumn("signup", (F.col("event_type") == "signup").cast("int"))
    return S.perfect_separators(f, ["protocol", "dst_port", "packet_count"], "signup")


@query("agg_21_split_report", f"""WITH {SPLIT},
d AS (SELECT partition, count(*) AS n, min(t_us) AS start_us, max(t_us) AS end_us,
    {B.sql_lanes('event_key')} FROM sf GROUP BY partition)
SELECT partition, n AS rows, start_us, end_us, {B.sql_digest()} AS identity_digest,
  abs(n / (SELECT count(*) FROM sf) - CASE partition WHEN 'training' THEN 0.7 ELSE 0.15 END)
    <= 0.05 AS ratio_ok,
  coalesce((SELECT max(end_us) FROM d x WHERE (x.partition, d.partition) IN
    (('training', 'validation'), ('validation', 'test'))) < start_us, TRUE) AS band_ok FROM d""")
def agg_21(spark, sf):
    return S.split_report(split_flows(spark, sf), "event_time", "event_key").select(
        "partition", "rows", B.micros("time_start").alias("start_us"),
        B.micros("time_end").alias("end_us"), "identity_digest", "ratio_ok", "band_ok")


@query("agg_25_prevalence", f"""WITH {SPLIT}
SELECT round(avg(label), 9) AS prevalence FROM sf WHERE partition = 'training'""")
def agg_25(spark, sf):
    return M.prevalence(split_flows(spark, sf)).select(F.round("prevalence", 9)
                                                       .alias("prevalence"))


# --- scores -------------------------------------------------------------------

def scored(spark, sf):
    """Arithmetic labels and scores with many ties."""
    k, e = F.col("k"), F.col("event_id")
    return B.events(spark, sf).select(
        "event_id", ((k + e) % 3 == 0).cast("int").alias("y"),
        (((k * 37 + (k + e) % 3 * 11) % 100) / 100.0).alias("p"))


SCORED = B.EVENTS + """,
sc AS (SELECT event_id, CAST((k + event_id) % 3 = 0 AS INT) AS y,
  ((k * 37 + (k + event_id) % 3 * 11) % 100) / 100.0::DOUBLE AS p FROM ev)"""


@query("agg_22_binary_metrics", f"""WITH {SCORED},
c AS (SELECT count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
  count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn,
  count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, avg((p - y) * (p - y)) AS brier FROM sc),
r AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1,
  tp / (tp + fn) AS r1 FROM c),
f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM r)
SELECT tn, fp, fn, tp, round(p1, 9) AS precision_1, round(r1, 9) AS recall_1,
  round(f0, 9) AS f1_0, round(f1, 9) AS f1_1, round((f0 + f1) / 2, 9) AS macro_f1,
  round((f0 * (tn + fp) + f1 * (tp + fn)) / (tn + fp + fn + tp), 9) AS weighted_f1,
  round(fp / (fp + tn), 9) AS false_positive_rate, round(fn / (fn + tp), 9) AS false_negative_rate,
  round(brier, 9) AS brier FROM f""")
def agg_22(spark, sf):
    names = ["precision_1", "recall_1", "f1_0", "f1_1", "macro_f1", "weighted_f1",
             "false_positive_rate", "false_negative_rate", "brier"]
    return M.binary_metrics(scored(spark, sf), "y", "p").select(
        "tn", "fp", "fn", "tp", *[F.round(n, 9).alias(n) for n in names])


CURVE = f"""{SCORED},
g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY p),
u AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn
      FROM g)"""


@query("agg_23_roc_auc", f"""WITH {CURVE}
SELECT round(sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM u""")
def agg_23(spark, sf):
    return M.roc_auc(scored(spark, sf), "y", "p").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("agg_24_average_precision", f"""WITH {CURVE}
SELECT round(sum(pos * cp / (cp + cn)) / sum(pos), 9) AS average_precision FROM u""")
def agg_24(spark, sf):
    return M.average_precision(scored(spark, sf), "y", "p").select(
        F.round("average_precision", 9).alias("average_precision"))


# --- encoders -----------------------------------------------------------------

@query("ml_1_vocabulary", f"""WITH {SPLIT},
v AS (SELECT protocol || '-' || k AS token, count(*) AS frequency FROM sf
  WHERE partition = 'training' GROUP BY 1 HAVING count(*) >= 2)
SELECT token, row_number() OVER (ORDER BY token COLLATE C) + 1 AS ordinal, frequency FROM v"""
       .replace(" COLLATE C", ""))
def ml_1(spark, sf):
    rows = split_flows(spark, sf).withColumn("token", F.concat_ws("-", "protocol", B.text("k")))
    return E.fit_vocabulary(rows.withColumnRenamed("token", "word"), "word", 2)


@query("ml_2_ordinal_codes", f"""WITH {SPLIT},
v AS (SELECT state AS token, row_number() OVER (ORDER BY state) + 1 AS ordinal FROM
  (SELECT DISTINCT state FROM sf WHERE partition = 'training' AND state IS NOT NULL
   AND state < 'SE'))
SELECT event_key, CASE WHEN state IS NULL THEN 0 ELSE coalesce(ordinal, 1) END AS code,
  CAST(CASE WHEN state IN ({B.sql_list(K.STATE_VOCABULARY)}) THEN
    list_position([{B.sql_list(K.STATE_VOCABULARY)}], state) - 1 ELSE 1 END AS BIGINT) AS fixed
FROM sf LEFT JOIN v ON state = token""")
def ml_2(spark, sf):
    rows = split_flows(spark, sf)
    known = rows.where("state < 'SE'")
    coded = E.encode(rows, "state", E.fit_vocabulary(known, "state"), "code")
    return coded.select("event_key", "code", E.encode_fixed(
        F.col("state"), K.STATE_VOCABULARY).cast("long").alias("fixed"))


@query("ml_3_robust_scale", f"""WITH {SPLIT},
q AS (SELECT quantile_cont(duration_ms::DOUBLE, 0.5) AS c1,
  quantile_cont(duration_ms::DOUBLE, 0.75) - quantile_cont(duration_ms::DOUBLE, 0.25) AS s1,
  quantile_cont(byte_count::DOUBLE, 0.5) AS c2,
  quantile_cont(byte_count::DOUBLE, 0.75) - quantile_cont(byte_count::DOUBLE, 0.25) AS s2
  FROM sf WHERE partition = 'training')
SELECT event_key, round((duration_ms - c1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6)
    AS duration_ms, round((byte_count - c2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6)
    AS byte_count FROM sf, q""")
def ml_3(spark, sf):
    rows = split_flows(spark, sf).select("event_key", "partition", "duration_ms", "byte_count")
    return E.robust_scale(rows, ["duration_ms", "byte_count"]).select(
        "event_key", F.round("duration_ms", 6).alias("duration_ms"),
        F.round("byte_count", 6).alias("byte_count"))


@query("ml_9_normalized_scores", f"""WITH {SPLIT},
a AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM sf
  WHERE partition = 'training')
SELECT event_key, round(least(1.0, greatest(0.0, (value - lo) / (hi - lo))), 6) AS score
FROM sf, a""")
def ml_9(spark, sf):
    rows = split_flows(spark, sf)
    anchors = E.score_anchors(rows.where("partition = 'training'"), "value")
    return E.normalize_scores(rows, "value", anchors).select(
        "event_key", F.round("score", 6).alias("score"))


@query("ml_10_threshold_flags", f"""WITH {SPLIT},
t AS (SELECT quantile_cont(value, 0.95) AS cut FROM sf
  WHERE partition = 'validation' AND label = 0)
SELECT event_key, round(cut, 6) AS threshold FROM sf, t WHERE value >= cut""")
def ml_10(spark, sf):
    rows = split_flows(spark, sf)
    cut = E.quantile_threshold(rows.where("partition = 'validation' AND label = 0"), "value")
    return E.flagged(rows, cut, "value").select(
        "event_key", F.round(F.lit(cut.first()["threshold"]), 6).alias("threshold"))


@query("ml_13_baseline_medians", f"""WITH {SPLIT},
b AS (SELECT * FROM sf WHERE partition = 'training' AND label = 0)
SELECT 'duration_ms' AS feature, quantile_cont(duration_ms::DOUBLE, 0.5) AS median FROM b
UNION ALL SELECT 'packet_count', quantile_cont(packet_count::DOUBLE, 0.5) FROM b
UNION ALL SELECT 'value', round(quantile_cont(value, 0.5), 6) FROM b""")
def ml_13(spark, sf):
    return E.baseline_medians(split_flows(spark, sf), ["duration_ms", "packet_count", "value"]) \
        .select("feature", F.round("median", 6).alias("median"))


@query("agg_26_exact_quantiles", f"""WITH {B.FLOWS}
SELECT src_address, round(quantile_cont(value, 0.05), 6) AS q05,
  round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95
FROM flows GROUP BY src_address""")
def agg_26_quantiles(spark, sf):
    q = quantiles(B.flows(spark, sf), F.col("value"), {"q05": 0.05, "q50": 0.5, "q95": 0.95},
                  ["src_address"])
    return q.select("src_address", *[F.round(c, 6).alias(c) for c in ("q05", "q50", "q95")])
