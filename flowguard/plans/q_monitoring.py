"""Snapshots, drift, service levels, reports and lists."""


from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.operators import drift as D, reports as R
from flowguard.plans import bindings as B
from flowguard.plans.q_workflow import jobs
from flowguard.plans.registry import query


def halves(spark, sf):
    """Line items by half-year."""
    d = F.col("l_shipdate")
    return B.table(spark, sf, "lineitem").withColumns({
        "half": F.year(d) * 10 + F.when(F.month(d) <= 6, 1).otherwise(2),
        "item": F.concat_ws("-", B.text("l_orderkey"), B.text("l_partkey"))})


HALVES = """
h AS (SELECT *, year(l_shipdate) * 10 + CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END AS half,
  l_orderkey || '-' || l_partkey AS item FROM lineitem),
wide AS (SELECT half, count(*) AS samples, count(*)::DOUBLE AS row_count,
  count(DISTINCT l_suppkey)::DOUBLE AS group_count, avg((l_discount = 0)::INT) AS missing_rate,
  avg((l_returnflag = 'N')::INT) AS unseen_rate, avg((l_quantity > 45)::INT) AS range_failure_rate,
  (count(*) - count(DISTINCT item)) / count(*) AS duplicate_rate, avg(l_tax) AS score_mean,
  stddev_pop(l_tax) AS score_stddev, avg((l_returnflag = 'R')::INT) AS positive_rate,
  quantile_cont(l_extendedprice, 0.5) AS latency_ms_p50,
  quantile_cont(l_extendedprice, 0.95) AS latency_ms_p95 FROM h GROUP BY half),
snap AS (""" + " UNION ALL ".join(
    f"SELECT half, '{m}' AS metric_key, {m}::DOUBLE AS value, samples AS sample_count FROM wide"
    for m in K.METRIC_KEYS) + ")"


@B.shared_plan
def snapshots(spark, sf):
    return D.metric_snapshot(
        halves(spark, sf), ["half"], "item", "l_suppkey", F.col("l_discount") == 0,
        F.col("l_returnflag") == "N", F.col("l_quantity") > 45, "l_tax",
        F.col("l_returnflag") == "R", "l_extendedprice")


@query("agg_26_metric_snapshot", f"""WITH {HALVES}
SELECT CAST(half AS BIGINT) AS half, metric_key, round(value, 6) AS value, sample_count
FROM snap""")
def agg_26(spark, sf):
    return snapshots(spark, sf).select(F.col("half").cast("long").alias("half"), "metric_key",
                                       F.round("value", 6).alias("value"), "sample_count")


PAIR = HALVES + f""",
b AS (SELECT CASE half % 10 WHEN 1 THEN half + 1 ELSE half + 9 END AS half, metric_key, value,
  sample_count FROM snap),
c AS (SELECT * FROM snap),
al AS (SELECT half, metric_key, b.value AS bv, c.value AS cv, least(coalesce(b.sample_count, 0),
    coalesce(c.sample_count, 0)) AS n FROM b FULL OUTER JOIN c USING (half, metric_key)),
dr AS (SELECT *, CASE WHEN bv IS NULL OR cv IS NULL OR n < 30 THEN NULL ELSE abs(cv - bv) END AS d
  FROM al),
st AS (SELECT *, CASE WHEN d IS NULL THEN 'not_evaluable' WHEN d >= 0.5 THEN 'critical'
  WHEN d >= 0.2 THEN 'warning' ELSE 'ok' END AS status FROM dr)"""


def pair(spark, sf):
    """Each half-year's snapshot and, under the same half, that of the half before it."""
    s = snapshots(spark, sf)
    following = F.when(F.col("half") % 10 == 1, F.col("half") + 1).otherwise(F.col("half") + 9)
    return s.withColumn("half", following), s


@query("jn_14_metric_alignment", f"""WITH {PAIR}
SELECT CAST(half AS BIGINT) AS half, metric_key, round(bv, 6) AS baseline_value,
  round(cv, 6) AS current_value FROM al""")
def jn_14(spark, sf):
    return D.align_metrics(*pair(spark, sf), ["half"]).select(
        F.col("half").cast("long").alias("half"), "metric_key", F.round("baseline_value", 6).alias("baseline_value"),
        F.round("current_value", 6).alias("current_value"))


@query("agg_18_drift", f"""WITH {PAIR}
SELECT CAST(half AS BIGINT) AS half, metric_key, round(d, 6) AS delta, status, CAST(n AS BIGINT) AS sample_count FROM st""")
def agg_18(spark, sf):
    return D.drift(*pair(spark, sf), ["half"]).select(
        F.col("half").cast("long").alias("half"), "metric_key", F.round("delta", 6).alias("delta"),
        "status", "sample_count")


@query("agg_18_drift_overall", f"""WITH {PAIR}
SELECT CAST(half AS BIGINT) AS half, CASE WHEN bool_or(status = 'not_evaluable') THEN 'not_evaluable'
  WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'warning') THEN 'warning'
  ELSE 'ok' END AS status, count(*) FILTER (WHERE status = 'warning') AS warning_count,
  count(*) FILTER (WHERE status = 'critical') AS critical_count FROM st GROUP BY half""")
def agg_18_overall(spark, sf):
    found = D.drift_overall(D.drift(*pair(spark, sf), ["half"]), ["half"])
    return found.withColumn("half", F.col("half").cast("long"))


@query("prj_20_metric_allow_list", """
WITH m AS (SELECT list_element(['row_count', 'score_mean', 'cpu_load', 'latency_ms_p95',
  'api_error_count', 'queue_depth', 'disk_free'], l_linenumber) AS metric_key FROM lineitem)
SELECT metric_key, count(*) AS n FROM m
WHERE metric_key IN ('row_count', 'score_mean', 'latency_ms_p95') GROUP BY 1
UNION ALL SELECT 'sli:' || metric_key, count(*) FROM m
WHERE metric_key IN ('api_error_count', 'queue_depth') GROUP BY 1""")
def prj_20(spark, sf):
    names = F.array(*[F.lit(s) for s in ("row_count", "score_mean", "cpu_load", "latency_ms_p95",
                                         "api_error_count", "queue_depth", "disk_free")])
    rows = B.table(spark, sf, "lineitem").select(
        F.get(names, F.col("l_linenumber") - 1).alias("metric_key"),
        F.lit("component").alias("dimension"))
    n = F.count(F.lit(1)).alias("n")
    return D.allowed_metrics(rows).groupBy("metric_key").agg(n).unionByName(
        D.allowed_slis(rows).groupBy(F.concat(F.lit("sli:"), "metric_key").alias("metric_key"))
        .agg(n))


WIDTH = 30 * B.DAY


KINDS = ("api", "queue", "task", "monitoring", "feedback", "artifact", "retention", "backup",
         "readiness")


def sli_count_sql():
    out = []
    for key, (kind, status, reason) in D.SLI_COUNTS.items():
        hit = f"kind = '{kind}'" + (f" AND status = '{status}'" if status else "") + (
            f" AND reason = '{reason}'" if reason else "")
        out.append(f"count(*) FILTER (WHERE {hit}) AS {key}")
    return ", ".join(out)


@query("agg_27_sli_snapshot", f"""
WITH e AS (SELECT (epoch_us(o_orderdate) // {WIDTH * 1000000}) * {WIDTH * 1000000} AS window_us,
  o_orderpriority AS component, o_totalprice AS ms, o_custkey % 600 AS age,
  list_element([{', '.join(f"'{k}'" for k in KINDS)}], CAST(o_orderkey % 9 AS INT) + 1) AS kind,
  CASE o_custkey % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'hash_mismatch' ELSE 'none' END AS reason,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'not_evaluable' END
    AS status FROM orders)
SELECT window_us, component, {sli_count_sql()},
  round(quantile_cont(ms, 0.5) FILTER (WHERE kind = 'api'), 4) AS api_latency_ms_p50,
  round(quantile_cont(ms, 0.95) FILTER (WHERE kind = 'api'), 4) AS api_latency_ms_p95,
  round(quantile_cont(age, 0.95) FILTER (WHERE kind = 'queue'), 4) AS queue_age_seconds_p95
FROM e GROUP BY 1, 2""")
def agg_27(spark, sf):
    s, reason = F.col("o_orderstatus"), F.col("o_custkey") % 3
    events = B.table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("occurred_at"), F.col("o_orderpriority").alias("component"),
        F.col("o_totalprice").alias("duration_ms"), (F.col("o_custkey") % 600).cast("double")
        .alias("age_seconds"),
        F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("o_orderkey") % 9).cast("int"))
        .alias("kind"),
        F.when(reason == 0, "stale").when(reason == 1, "hash_mismatch").otherwise("none")
        .alias("reason"),
        F.when(s == "F", "succeeded").when(s == "P", "failed").otherwise("not_evaluable")
        .alias("status"))
    tails = ("api_latency_ms_p50", "api_latency_ms_p95", "queue_age_seconds_p95")
    return D.sli_snapshot(events, WIDTH).select(
        B.micros("window_start").alias("window_us"), "component", *D.SLI_COUNTS,
        *[F.round(c, 4).alias(c) for c in tails])


# --- counts and reports ------------------------------------------------------------

JOBS_SQL = """
j AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'pending'
    WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderkey % 9 = 0 THEN 'failed'
    ELSE 'succeeded' END AS status, o_orderdate AS created_at FROM orders)"""


@query("agg_9_detection_metrics", f"""WITH {B.MERGED_ALERTS}, {JOBS_SQL}
SELECT 'runs_' || status AS metric, count(*) AS n FROM j GROUP BY status
UNION ALL SELECT 'signals', CAST(sum(id % 5) AS BIGINT) FROM j
UNION ALL SELECT 'alerts', CAST(sum(id % 3) AS BIGINT) FROM j
UNION ALL SELECT 'suppressed', CAST(sum(id % 2) AS BIGINT) FROM j
UNION ALL SELECT 'occurrences', CAST(sum(occurrence_count) AS BIGINT) FROM alerts""")
def agg_9(spark, sf):
    return R.detection_metrics(jobs(spark, sf), B.merged_alerts(spark, sf))


@query("agg_10_ingestion_metrics", f"""WITH {JOBS_SQL}
SELECT 'jobs_' || status AS metric, count(*) AS n FROM j GROUP BY status
UNION ALL SELECT 'accepted', CAST(sum(id % 100) AS BIGINT) FROM j
UNION ALL SELECT 'rejected', CAST(sum(id % 7) AS BIGINT) FROM j
UNION ALL SELECT 'duplicate', CAST(sum(id % 13) AS BIGINT) FROM j
UNION ALL SELECT 'delayed', count(*) FROM j WHERE status = 'pending'
  AND created_at < TIMESTAMP '1998-07-02'
UNION ALL SELECT 'failed', count(*) FROM j WHERE status = 'failed'""")
def agg_10(spark, sf):
    return R.ingestion_metrics(jobs(spark, sf), B.ORDERS_NOW, 31 * B.DAY)


@B.shared_plan
def report_tables(spark, sf):
    """Orders as runs, line items as metrics, feedback and events."""
    l, flag = B.table(spark, sf, "lineitem"), F.col("l_returnflag")
    return {
        "runs": jobs(spark, sf).select(F.col("job_id").alias("run_id"), "status", "created_at",
                                       (F.col("job_id") % 3).alias("sample_count")),
        "metrics": l.select(F.col("l_orderkey").alias("run_id"),
                            F.when(flag == "A", "warning").when(flag == "R", "critical")
                            .otherwise("ok").alias("status")),
        "feedback": l.select(
            F.when(flag == "R", "benign").otherwise("false_positive").alias("disposition"),
            F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("created_at"),
            F.sha2(F.concat(B.text("l_orderkey"), F.lit("|"), (F.col("l_partkey") % 4)
                            .cast("string")), 256).alias("evidence_hash")),
        "events": l.select(F.col("l_shipdate").alias("created_at")),
    }


REPORTS = JOBS_SQL + """,
r AS (SELECT id AS run_id, status, id % 3 AS sample_count FROM j
  WHERE created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01'),
m AS (SELECT CASE l_returnflag WHEN 'A' THEN 'warning' WHEN 'R' THEN 'critical' ELSE 'ok' END
  AS status FROM lineitem WHERE l_orderkey IN (SELECT run_id FROM r)),
fb AS (SELECT * FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01'),
oe AS (SELECT * FROM lineitem
  WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01'),
rs AS (SELECT 'run_status_counts' AS section, status AS key, count(*) AS n FROM r GROUP BY status),
ms AS (SELECT 'metric_status_counts', status, count(*) FROM m GROUP BY status),
rc AS (SELECT 'totals', 'run_count', count(*) FROM r),
fc AS (SELECT 'totals', 'feedback_count', count(*) FROM fb),
ec AS (SELECT 'totals', 'event_count', count(*) FROM oe),
rn AS (SELECT CAST(sum(sample_count) AS BIGINT) AS v FROM r),
fn AS (SELECT count(*) AS v FROM fb)"""


def report_sql():
    def bounded(kind, parts, size):
        body = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
        return f"""SELECT '{kind}' AS report_type, section, key, n, CASE WHEN v >= 30
  THEN 'complete' ELSE 'not_evaluable' END AS status FROM (
  SELECT * FROM ({body}) AS q(section, key, n) WHERE (SELECT v FROM {size}) >= 30
  UNION ALL SELECT 'totals', 'sample_count', v FROM {size}), {size}"""

    def plain(kind, parts):
        body = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
        return (f"SELECT '{kind}', section, key, n, 'complete' FROM ({body}) AS q(section, key, n)")
    return f"WITH {REPORTS} " + " UNION ALL ".join([
        bounded("synthetic_quality_drift", ["rs", "ms"], "rn"),
        bounded("synthetic_feedback_summary", ["fc"], "fn"),
        plain("synthetic_operations", ["ec", "rc"]),
        plain("synthetic_retention_recovery", ["ec"]),
        bounded("synthetic_gate_evidence", ["rc", "ec"], "rn")])


@query("agg_14_reports", report_sql())
def agg_14(spark, sf):
    out = None
    for kind in K.REPORT_TYPES:
        part = R.report(kind, start=B.utc(1995, 1, 1), end=B.utc(1996, 1, 1),
                        **report_tables(spark, sf))
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_12_summary", f"""WITH {JOBS_SQL}
SELECT count(*) AS run_count, (SELECT count(*) FROM lineitem) AS report_count,
  (SELECT count(*) FROM lineitem) AS feedback_count,
  sum(id % 3) >= 30 AS evaluable FROM j""")
def agg_12(spark, sf):
    t = report_tables(spark, sf)
    return R.summary(t["runs"], t["events"], t["feedback"])


@query("agg_13_feedback", """
SELECT CASE WHEN l_returnflag = 'R' THEN 'benign' ELSE 'false_positive' END AS disposition,
  count(*) AS n FROM lineitem GROUP BY 1""")
def agg_13(spark, sf):
    return R.feedback_summary(report_tables(spark, sf)["feedback"])


@query("agg_28_inventory", """
SELECT 'orders' AS table_name, count(*) AS n FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'events', count(*) FROM events""")
def agg_28(spark, sf):
    return R.inventory({n: B.table(spark, sf, n) for n in ("orders", "lineitem", "events")})


@query("jn_18_feedback_evidence", """
SELECT l_orderkey AS run_id, sha256(l_orderkey || '|' || (l_partkey % 4)) AS evidence_hash
FROM lineitem WHERE l_partkey % 4 < 3
  AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def jn_18(spark, sf):
    t = report_tables(spark, sf)
    runs = t["runs"].withColumn("hashes", F.array(*[
        F.sha2(F.concat(B.text("run_id"), F.lit(f"|{i}")), 256) for i in range(3)]))
    return R.feedback_valid(t["feedback"], runs).select("run_id", "evidence_hash")


@query("srt_6_recent", f"""WITH {JOBS_SQL}
SELECT id, status FROM j WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 25""")
def srt_6(spark, sf):
    return R.recent(jobs(spark, sf), 25, "status = 'failed'", tie="job_id").select(
        F.col("job_id").alias("id"), "status")


@query("srt_8_ordered_metrics", f"""WITH {HALVES}
SELECT CAST(half AS BIGINT) AS half, metric_key, sample_count FROM snap
ORDER BY half, metric_key""")
def srt_8(spark, sf):
    return R.ordered(snapshots(spark, sf).select(
        F.col("half").cast("long").alias("half"), "metric_key", "sample_count"), "half",
        "metric_key")


@query("srt_8_ordered_notes", """
SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn""")
def srt_8_notes(spark, sf):
    return R.ordered(B.table(spark, sf, "conversations").select("conv_id", "turn", "role"),
                     "conv_id", "turn")
