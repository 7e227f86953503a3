"""State machines, intake, queues, retention."""


from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.operators import retention as R, workflow as WF
from flowguard.plans import bindings as B
from flowguard.plans.registry import query

# (event type, expected state, wanted state) per machine
ALERT_STEPS = (("click", "new", "acknowledged"), ("view", "acknowledged", "investigating"),
               ("purchase", "investigating", "closed"), ("error", "closed", "investigating"),
               ("signup", "acknowledged", "closed"))
INCIDENT_STEPS = (("click", "open", "investigating"), ("view", "investigating", "resolved"),
                  ("purchase", "resolved", "closed"), ("error", "closed", "investigating"),
                  ("signup", "resolved", "investigating"))
REQUEST_STEPS = (("click", "draft", "evaluated"), ("view", "evaluated", "previewed"),
                 ("purchase", "previewed", "simulated"), ("error", "simulated", "rolled_back"),
                 ("signup", "evaluated", "rejected"))


def step_events(spark, sf, steps, dispositions=True):
    """Each event asks for one step of its user's workflow."""
    e, k = B.events(spark, sf), F.col("k")
    now, then = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, a, b in steps:
        now = F.when(F.col("event_type") == kind, a).otherwise(now)
        then = F.when(F.col("event_type") == kind, b).otherwise(then)
    closes = (then == "closed") & (k % 5 != 0)
    return e.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("at"),
                    F.col("event_id").alias("seq"), B.text("event_id").alias("step_id"),
                    now.alias("current"), then.alias("target"),
                    F.when(F.lit(dispositions) & (closes | (k == 3)), "benign")
                    .alias("disposition"))


def steps_sql(steps, initial, dispositions=True):
    """The same steps, folded one after the other by a recursive query."""
    case = lambda i: "CASE event_type " + " ".join(
        f"WHEN '{s[0]}' THEN '{s[i]}'" for s in steps) + " END"
    disp = "CASE WHEN (target = 'closed' AND k % 5 <> 0) OR k = 3 THEN 'benign' END" \
        if dispositions else "CAST(NULL AS VARCHAR)"
    error = """CASE WHEN target = 'closed' AND disposition IS NULL THEN 'close_requires_disposition'
      WHEN target <> 'closed' AND disposition IS NOT NULL THEN 'disposition_only_on_close' END""" \
        if dispositions else "CAST(NULL AS VARCHAR)"
    return f"""RECURSIVE {B.EVENTS.strip()},
s0 AS (SELECT *, {case(1)} AS current, {case(2)} AS target FROM ev),
s1 AS (SELECT *, {disp} AS disposition FROM s0),
s2 AS (SELECT event_id, user_id, current, target, disposition, {error} AS own,
  row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn FROM s1),
fold AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, '{initial}' AS state, CAST(NULL AS BIGINT) AS event_id,
    CAST(NULL AS VARCHAR) AS before, CAST(NULL AS BOOLEAN) AS accepted,
    CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS disposition
  FROM (SELECT DISTINCT user_id FROM s2)
  UNION ALL
  SELECT s.user_id, s.rn, CASE WHEN s.current = f.state AND own IS NULL THEN s.target
      ELSE f.state END, s.event_id, f.state, s.current = f.state AND own IS NULL,
    CASE WHEN s.current <> f.state THEN 'state_conflict' ELSE own END, s.disposition
  FROM fold f JOIN s2 s ON s.user_id = f.user_id AND s.rn = f.rn + 1)"""


def _machine(key, steps, machine, initial, dispositions=True):
    base = steps_sql(steps, initial, dispositions)

    @query(f"{key}_steps", f"""WITH {base}
SELECT CAST(event_id AS VARCHAR) AS step_id, before, accepted, error FROM fold WHERE rn > 0""")
    def run(spark, sf):
        return WF.fold_transitions(step_events(spark, sf, steps, dispositions), machine, initial,
                                   dispositions=dispositions) \
            .select("step_id", "before", "accepted", "error")

    @query(f"{key}_final", f"""WITH {base}
SELECT user_id AS entity_id, arg_max(state, rn) AS state,
  count(*) FILTER (WHERE accepted) AS accepted_steps,
  count(*) FILTER (WHERE NOT accepted) AS refused_steps FROM fold GROUP BY user_id""")
    def final(spark, sf):
        folded = WF.fold_transitions(step_events(spark, sf, steps, dispositions), machine,
                                     initial, dispositions=dispositions)
        return WF.final_states(folded, initial).drop("disposition")
    return run, final


_machine("fld_1_alert_lifecycle", ALERT_STEPS, K.ALERT_TRANSITIONS, "new")
_machine("fld_2_incident_lifecycle", INCIDENT_STEPS, K.INCIDENT_TRANSITIONS, "open")
_machine("fld_3_request_lifecycle", REQUEST_STEPS, K.REQUEST_TRANSITIONS, "draft", False)


@query("fld_6_transition_check", f"""WITH {B.EVENTS},
m AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, t in K.ALERT_TRANSITIONS.items()
                                       for b in t)}) AS v(current, target)),
p AS (SELECT event_id, list_element(['new', 'acknowledged', 'investigating', 'closed'], k % 4 + 1)
    AS current, list_element(['new', 'acknowledged', 'investigating', 'closed'],
    CAST(event_id % 4 + 1 AS INT)) AS target, CASE WHEN k % 3 = 0 THEN 'benign' END AS disposition
  FROM ev)
SELECT event_id, CASE WHEN m.current IS NULL THEN 'invalid_transition'
  WHEN p.target = 'closed' AND disposition IS NULL THEN 'close_requires_disposition'
  WHEN p.target <> 'closed' AND disposition IS NOT NULL THEN 'disposition_only_on_close' END
  AS error FROM p LEFT JOIN m ON m.current = p.current AND m.target = p.target""")
def fld_6(spark, sf):
    names = F.array(*[F.lit(s) for s in ("new", "acknowledged", "investigating", "closed")])
    rows = B.events(spark, sf).select(
        "event_id", F.get(names, F.col("k") % 4).alias("current"),
        F.get(names, (F.col("event_id") % 4).cast("int")).alias("target"),
        F.when(F.col("k") % 3 == 0, "benign").alias("disposition"))
    return WF.check_transitions(rows, K.ALERT_TRANSITIONS).select("event_id", "error")


def rule_events(spark, sf):
    """Events as reviews, activations and deactivations of forty rules."""
    k, e = F.col("k"), F.col("event_id")
    kind = F.when(F.col("event_type").isin("signup", "view"), "review").when(
        F.col("event_type") == "error", "deactivate").otherwise("activate")
    return B.events(spark, sf).select(
        F.concat(F.lit("rule-"), (F.col("user_id") % 40).cast("string")).alias("rule_key"),
        F.col("ts").alias("at"), e.alias("seq"), B.text("event_id").alias("step_id"),
        kind.alias("kind"), (k % 3 + 1).alias("version"), (k % 4 != 0).alias("approved"),
        F.when(e % 3 != 0, (e % 3).cast("int") + F.when(k % 2 == 0, 1).otherwise(0))
        .alias("expected_version"))


@query("fld_4_rule_lifecycle", f"""WITH RECURSIVE {B.EVENTS.strip()},
r0 AS (SELECT 'rule-' || (user_id % 40) AS rule_key, t_us, event_id, k % 3 + 1 AS version,
  CASE WHEN event_type IN ('signup', 'view') THEN 'review' WHEN event_type = 'error'
    THEN 'deactivate' ELSE 'activate' END AS kind, k % 4 <> 0 AS approved,
  CASE WHEN event_id % 3 <> 0 THEN event_id % 3 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END
    AS expected FROM ev),
rev AS (SELECT rule_key, version, min((t_us, event_id)) AS at, arg_min(approved, (t_us, event_id))
    AS approved FROM r0 WHERE kind = 'review' GROUP BY 1, 2),
acts AS (SELECT a.*, coalesce(rev.approved AND rev.at < (a.t_us, a.event_id), FALSE) AS fine,
  row_number() OVER (PARTITION BY a.rule_key ORDER BY a.t_us, a.event_id) AS rn
  FROM r0 a LEFT JOIN rev USING (rule_key, version) WHERE a.kind <> 'review'),
fold AS (
  SELECT rule_key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS active,
    CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS was, CAST(NULL AS VARCHAR) AS action
  FROM (SELECT DISTINCT rule_key FROM acts)
  UNION ALL
  SELECT a.rule_key, a.rn,
    CASE WHEN a.expected IS DISTINCT FROM f.active THEN f.active
      WHEN a.kind = 'deactivate' THEN NULL WHEN a.fine THEN a.version ELSE f.active END,
    a.event_id, f.active,
    CASE WHEN a.expected IS DISTINCT FROM f.active THEN 'active_rule_changed'
      WHEN a.kind = 'deactivate' THEN CASE WHEN f.active IS NULL THEN 'active_rule_not_found'
        ELSE 'deactivate' END
      WHEN NOT a.fine THEN 'rule_not_approved' WHEN f.active = a.version THEN 'unchanged'
      WHEN f.active > a.version THEN 'rollback' ELSE 'activate' END
  FROM fold f JOIN acts a ON a.rule_key = f.rule_key AND a.rn = f.rn + 1)
SELECT rule_key, CAST(event_id AS VARCHAR) AS step_id, was AS previous_version, action
FROM fold WHERE rn > 0""")
def fld_4(spark, sf):
    return WF.fold_rule_lifecycle(rule_events(spark, sf)).select(
        "rule_key", "step_id", F.col("previous_version").cast("long").alias("previous_version"),
        "action")


@query("fld_7_self_reviews", """
SELECT o_orderkey AS id FROM orders WHERE o_custkey % 10 = o_orderkey % 10""")
def fld_7(spark, sf):
    rows = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("created_by"),
        (F.col("o_orderkey") % 10).alias("reviewed_by"))
    return WF.self_reviews(rows).select("id")


@query("fld_8_first_requests", """
WITH r AS (SELECT o_custkey % 100 AS actor_id, o_orderpriority || year(o_orderdate)
    AS idempotency_key, o_orderdate AS created_at, o_orderkey AS request_id,
    sha256(o_orderstatus) AS payload_hash FROM orders)
SELECT actor_id, idempotency_key, arg_min(request_id, (created_at, request_id)) AS request_id,
  count(*) AS copies, count(DISTINCT payload_hash) > 1 AS conflict FROM r GROUP BY 1, 2""")
def fld_8(spark, sf):
    rows = B.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).alias("actor_id"), F.concat("o_orderpriority", F.year(
            "o_orderdate").cast("string")).alias("idempotency_key"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("request_id"),
        F.sha2("o_orderstatus", 256).alias("payload_hash"))
    return WF.first_requests(rows)


@B.shared_plan
def jobs(spark, sf):
    """Orders as jobs."""
    s, key = F.col("o_orderstatus"), F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(
        key.alias("job_id"), F.col("o_custkey").alias("actor_id"),
        F.when(s == "O", "pending").when(s == "P", "processing")
        .when(key % 9 == 0, "failed").otherwise("succeeded").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("started_at"),
        (key % 100).alias("accepted_records"), (key % 7).alias("rejected_records"),
        (key % 13).alias("duplicate_records"), (key % 5).alias("signal_count"),
        (key % 3).alias("alert_count"), (key % 2).alias("suppressed_count"))


JOBS = """
jobs AS (SELECT o_orderkey AS job_id, o_custkey AS actor_id, CASE WHEN o_orderstatus = 'O'
    THEN 'pending' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderkey % 9 = 0 THEN 'failed'
    ELSE 'succeeded' END AS status, o_orderdate AS created_at,
  o_orderdate + INTERVAL 2 DAY AS started_at FROM orders)"""


@query("fld_9_stale_work", f"""WITH {JOBS}
SELECT job_id, status FROM jobs
WHERE (status = 'pending' AND created_at < TIMESTAMP '1998-07-02')
  OR (status = 'processing' AND started_at < TIMESTAMP '1998-07-28')
ORDER BY created_at, job_id LIMIT 100""")
def fld_9(spark, sf):
    return WF.stale_work(jobs(spark, sf), B.ORDERS_NOW, 31 * B.DAY, 5 * B.DAY, 100).select("job_id",
                                                                                     "status")


@query("fld_10_quota", f"""WITH {JOBS}
SELECT actor_id, count(*) AS in_flight FROM jobs WHERE status IN ('pending', 'processing')
GROUP BY actor_id HAVING count(*) >= 3""")
def fld_10(spark, sf):
    return WF.over_quota(jobs(spark, sf))


# --- retention -------------------------------------------------------------------

FLOW_NOW = B.utc(2024, 2, 15)


@query("ret_1_flow_expiry", f"""WITH {B.FLOWS}
SELECT 'flows' AS kept, event_key FROM flows WHERE ingested_at >= TIMESTAMP '2024-01-16'
UNION ALL SELECT 'ledger', event_key FROM flows
WHERE ingested_at >= TIMESTAMP '2024-01-16'""")
def ret_1(spark, sf):
    f = B.flows(spark, sf)
    kept, ledger = R.expire_flows(f, f.select("event_key", "schema_version"), FLOW_NOW)
    return kept.select(F.lit("flows").alias("kept"), "event_key").unionByName(
        ledger.select(F.lit("ledger").alias("kept"), "event_key"))


def detection_tables(spark, sf):
    """Customers, orders and line items as alerts, runs, signals and evidence."""
    o, l = B.table(spark, sf, "orders"), B.table(spark, sf, "lineitem")
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return {
        "alerts": o.select(
            F.col("o_orderkey").alias("alert_id"), F.col("o_orderdate").alias("created_at")),
        "evidence": l.select(
            item.alias("evidence_id"), F.col("l_orderkey").alias("alert_id"),
            F.when(F.col("l_linenumber") != 2, item).alias("signal_id")),
        "signals": l.select(item.alias("signal_id"), F.col("l_orderkey").alias("run_id"),
                            F.col("l_shipdate").alias("created_at")),
        "signatures": l.select(item.alias("event_id"), F.col("l_shipdate").alias("created_at")),
        "runs": o.select(F.col("o_orderkey").alias("run_id"),
                         F.col("o_orderdate").alias("created_at")),
    }


@query("ret_2_detection_expiry", """
WITH l AS (SELECT *, l_orderkey * 10 + l_linenumber AS item FROM lineitem),
young AS (SELECT * FROM l WHERE l_shipdate >= TIMESTAMP '1998-07-03'),
ev AS (SELECT item, CASE WHEN l_linenumber <> 2 AND item NOT IN (
      SELECT item FROM l WHERE l_shipdate < TIMESTAMP '1998-07-03') THEN item END AS signal_id
  FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders
    WHERE o_orderdate < TIMESTAMP '1998-02-03'))
SELECT 'alerts' AS kept, o_orderkey AS id, NULL::BIGINT AS signal_id FROM orders
  WHERE o_orderdate >= TIMESTAMP '1998-02-03'
UNION ALL SELECT 'evidence', item, signal_id FROM ev
UNION ALL SELECT 'signals', item, item FROM young
UNION ALL SELECT 'signatures', item, NULL FROM young
UNION ALL SELECT 'runs', o_orderkey, NULL FROM orders
  WHERE o_orderdate >= TIMESTAMP '1998-07-03' OR o_orderkey IN (SELECT l_orderkey FROM young)""")
def ret_2(spark, sf):
    kept = R.expire_detection(now=B.ORDERS_NOW, **detection_tables(spark, sf))
    ids = {"alerts": "alert_id", "evidence": "evidence_id", "signals": "signal_id",
           "signatures": "event_id", "runs": "run_id"}
    out = None
    for name, df in kept.items():
        signal = F.col("signal_id") if "signal_id" in df.columns else F.lit(None).cast("long")
        part = df.select(F.lit(name).alias("kept"), F.col(ids[name]).alias("id"),
                         signal.alias("signal_id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("ret_3_expiry_and_redaction", f"""WITH {B.REQUESTS}
SELECT request_id, expires_at > TIMESTAMP '1998-08-02' AS kept,
  CASE WHEN expires_at > TIMESTAMP '1998-08-02' THEN target_value END AS target_value
FROM requests""")
def ret_3(spark, sf):
    r = B.requests(spark, sf)
    kept = R.expire(r, B.ORDERS_NOW).select("request_id", F.lit(True).alias("_k"))
    return R.redact(r, B.ORDERS_NOW, ["target_value"]).join(kept, "request_id", "left").select(
        "request_id", F.coalesce("_k", F.lit(False)).alias("kept"), "target_value")
