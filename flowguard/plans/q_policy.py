"""Indicators, techniques, policy gates and their facts."""

from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.operators import gates as G, matching as X, workflow as WF
from flowguard.plans import bindings as B
from flowguard.plans.registry import query

EV_NOW, OR_NOW = "TIMESTAMP '2024-01-20'", "TIMESTAMP '1998-08-02'"


def allowed_values(spark, sf):
    """Hashes of the sources whose number is a multiple of seven."""
    return B.flows(spark, sf).select("src_address").distinct().where(
        F.element_at(F.split("src_address", "\\."), -1).cast("int") % 7 == 0).select(
        F.sha2(F.concat(F.lit("ipv4:"), F.col("src_address")), 256).alias("value_hash"))


MATCHES = f"""{B.FLOWS}, {B.INDICATORS},
allowed AS (SELECT DISTINCT sha256('ipv4:' || src_address) AS value_hash FROM flows
  WHERE CAST(split_part(src_address, '.', 4) AS INT) % 7 = 0),
matched AS (SELECT sha256(i.indicator_hash || ':' || o.provenance_hash) AS match_id,
  o.indicator_type, o.value_hash, i.source_name,
  CASE WHEN a.value_hash IS NOT NULL THEN 'allowlist_conflict'
    WHEN {EV_NOW} >= i.expires_at THEN 'expired' ELSE 'active' END AS state
  FROM observations o JOIN indicators i USING (indicator_type, value_hash)
  LEFT JOIN allowed a ON a.value_hash = o.value_hash)"""


def matched(spark, sf):
    return X.match_indicators(B.indicators(spark, sf), B.observations(spark, sf),
                              allowed_values(spark, sf), B.EVENTS_NOW)


@query("jn_7_indicator_match", f"""WITH {MATCHES}
SELECT match_id, indicator_type, value_hash, source_name FROM matched""")
def jn_7(spark, sf):
    return matched(spark, sf).select("match_id", "indicator_type", "value_hash", "source_name")


@query("jn_8_match_state", f"WITH {MATCHES} SELECT match_id, state FROM matched")
def jn_8(spark, sf):
    return matched(spark, sf).select("match_id", "state")


@query("agg_16_match_states", f"WITH {MATCHES} SELECT state, count(*) AS n FROM matched GROUP BY 1")
def agg_16(spark, sf):
    from flowguard.operators.reports import state_counts
    return state_counts(matched(spark, sf), "state")


def technique_tables(spark, sf):
    """Part types as techniques, brands as evidence classes naming them."""
    part = B.table(spark, sf, "part")
    catalog = part.select(F.concat(F.lit("T"), F.lpad((F.col("p_partkey") % 35).cast("string"), 4,
                                                      "0")).alias("technique_id")).distinct() \
        .select("technique_id", F.concat(F.lit("name "), F.col("technique_id")).alias("name"),
                F.lit("discovery").alias("tactic"))
    rules = part.select(
        F.concat(F.lit("rule-"), B.text("p_partkey")).alias("rule_key"),
        F.array(*[F.concat(F.lit("T"), F.lpad((F.col(c) % 40).cast("string"), 4, "0"))
                  for c in ("p_partkey", "p_size")]).alias("technique_ids"))
    return catalog, rules


TECHNIQUES = """
cat AS (SELECT DISTINCT 'T' || lpad(CAST(p_partkey % 35 AS VARCHAR), 4, '0') AS technique_id
  FROM part),
maps AS (SELECT 'rule-' || p_partkey AS rule_key, unnest([
    'T' || lpad(CAST(p_partkey % 40 AS VARCHAR), 4, '0'),
    'T' || lpad(CAST(p_size % 40 AS VARCHAR), 4, '0')]) AS technique_id FROM part)"""


@query("jn_17_technique_mapping", f"""WITH {TECHNIQUES}
SELECT technique_id, 'name ' || technique_id AS name, 'discovery' AS tactic,
  rule_key AS evidence_class, 'high' AS confidence FROM maps JOIN cat USING (technique_id)""")
def jn_17(spark, sf):
    catalog, rules = technique_tables(spark, sf)
    maps = X.explode_techniques(rules).select(
        "technique_id", F.col("rule_key").alias("evidence_class"), F.lit("high")
        .alias("confidence"))
    return X.map_techniques(maps, catalog)


@query("jn_17_technique_errors", f"""WITH {TECHNIQUES}
SELECT DISTINCT technique_id, 'unknown_technique' AS error FROM maps
WHERE technique_id NOT IN (SELECT technique_id FROM cat)""")
def jn_17_errors(spark, sf):
    catalog, rules = technique_tables(spark, sf)
    return X.technique_errors(X.explode_techniques(rules), catalog)


# --- facts the gates ask for -----------------------------------------------------

LISTED = f"""EXISTS (SELECT 1 FROM allow a WHERE a.target_type = r.target_type
    AND a.target_value = r.target_value AND (a.expires_at IS NULL OR a.expires_at > {OR_NOW}))"""
CRITICAL = """EXISTS (SELECT 1 FROM assets a WHERE a.address = r.target_value AND a.is_active
    AND a.criticality = 'critical')"""


@query("jn_9_allowlist_lookup", f"WITH {B.POLICY} SELECT request_id FROM requests r WHERE {LISTED}")
def jn_9(spark, sf):
    return G.allowlisted(B.requests(spark, sf), B.policy_tables(spark, sf)["allow"],
                         B.ORDERS_NOW).select("request_id")


@query("jn_10_critical_asset", f"WITH {B.POLICY} SELECT request_id FROM requests r WHERE {CRITICAL}")
def jn_10(spark, sf):
    return G.critical_target(B.requests(spark, sf), B.assets(spark, sf)).select("request_id")


FACTS = B.POLICY + f""",
flags AS (
  SELECT r.*, (a.alert_id IS NOT NULL OR i.incident_id IS NOT NULL) AS evidence_present,
    coalesce(a.source_type IN ({B.sql_list(K.DETERMINISTIC_SOURCES)}), FALSE)
      OR coalesce(m.sure, FALSE) AS corroborated,
    x.expires_at IS NOT NULL AS intelligence_used,
    coalesce(x.expires_at > {OR_NOW}, TRUE) AS intelligence_fresh,
    {LISTED} AS allowlist_match, {CRITICAL} AS target_is_critical,
    EXISTS (SELECT 1 FROM requests o WHERE o.action_type = r.action_type
      AND o.target_type = r.target_type AND o.target_value = r.target_value
      AND o.status NOT IN ({B.sql_list(K.REQUEST_TERMINAL)})
      AND (o.created_at, o.request_id) < (r.created_at, r.request_id)) AS duplicate_detected,
    EXISTS (SELECT 1 FROM requests o WHERE o.target_type = r.target_type
      AND o.target_value = r.target_value AND o.created_at >= r.created_at - INTERVAL 30 DAY
      AND (o.created_at, o.request_id) < (r.created_at, r.request_id)) AS cooldown_active
  FROM requests r LEFT JOIN p_alerts a USING (alert_id)
  LEFT JOIN incidents i ON i.incident_id = r.incident_id
  LEFT JOIN (SELECT members.incident_id, bool_or(source_type IN (
      {B.sql_list(K.DETERMINISTIC_SOURCES)})) AS sure FROM members JOIN p_alerts USING (alert_id)
    GROUP BY 1) m ON m.incident_id = i.incident_id
  LEFT JOIN p_indicators x ON x.indicator_id = r.indicator_id)"""


@query("jn_11_evidence_flags", f"""WITH {FACTS}
SELECT request_id, evidence_present, corroborated, evidence_present AND NOT corroborated
  AS model_only FROM flags""")
def jn_11(spark, sf):
    t = B.policy_tables(spark, sf)
    return G.evidence_flags(B.requests(spark, sf), t["alerts"], t["incidents"], t["members"])


@query("jn_12_intelligence_flags", f"""WITH {FACTS}
SELECT request_id, intelligence_used, intelligence_used AND NOT corroborated AS intelligence_sole,
  intelligence_fresh FROM flags""")
def jn_12(spark, sf):
    t, r = B.policy_tables(spark, sf), B.requests(spark, sf)
    flags = G.evidence_flags(r, t["alerts"], t["incidents"], t["members"])
    return G.intelligence_flags(r.join(flags, "request_id"), t["indicators"], B.ORDERS_NOW)


COOLDOWN = 30 * B.DAY


@query("fld_5_replay_flags", f"""WITH {FACTS}
SELECT request_id, duplicate_detected, cooldown_active FROM flags""")
def replay(spark, sf):
    return G.replay_flags(B.requests(spark, sf), COOLDOWN)


def context(spark, sf):
    t = B.policy_tables(spark, sf)
    return G.gate_context(B.requests(spark, sf), t["allow"], t["assets"], t["alerts"],
                          t["incidents"], t["members"], t["indicators"], B.ORDERS_NOW, COOLDOWN)


def gate_rows(spark, sf):
    return G.evaluate_gates(context(spark, sf))


GATES = FACTS + """,
gates AS (
  SELECT request_id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]) AS position,
    unnest([""" + B.sql_list(K.GATE_ORDER) + """]) AS gate_key,
    unnest(['ok', CASE WHEN has_permission THEN 'ok' ELSE 'missing_simulation_permission' END,
      CASE WHEN request_id % 6 NOT IN (4, 5) THEN 'ok' ELSE 'target_not_canonical' END,
      CASE target_type WHEN 'shell_command' THEN 'scope_unknown' WHEN 'internal_ip'
        THEN 'internal_stricter_denial' ELSE 'ok' END,
      CASE WHEN allowlist_match THEN 'target_allowlisted' ELSE 'ok' END,
      CASE WHEN target_is_critical THEN 'critical_asset_denied' ELSE 'ok' END,
      CASE WHEN NOT evidence_present THEN 'evidence_missing'
        WHEN NOT corroborated THEN 'evidence_not_corroborated' ELSE 'ok' END,
      CASE WHEN evidence_present AND NOT corroborated THEN 'model_or_anomaly_only' ELSE 'ok' END,
      CASE WHEN NOT intelligence_used THEN 'ok' WHEN NOT corroborated
        THEN 'intelligence_sole_proof' WHEN NOT intelligence_fresh
        THEN 'intelligence_stale_ignored' ELSE 'ok' END,
      CASE WHEN duration_seconds <= 0 THEN 'duration_not_positive' WHEN duration_seconds > 86400
        THEN 'duration_exceeds_policy_max' WHEN NOT has_expiry THEN 'expiry_missing'
        ELSE 'ok' END,
      CASE WHEN has_rollback_plan THEN 'ok' ELSE 'rollback_plan_missing' END,
      CASE WHEN duplicate_detected THEN 'duplicate_request' ELSE 'ok' END,
      CASE WHEN cooldown_active THEN 'cooldown_active' ELSE 'ok' END]) AS reason_code
  FROM flags),
judged AS (SELECT *, reason_code IN ('ok', 'intelligence_stale_ignored') AS passed FROM gates)"""


@query("fld_5_gate_results", f"""WITH {GATES}
SELECT request_id, CAST(position AS BIGINT) AS position, gate_key, passed, reason_code
FROM judged""")
def fld_5(spark, sf):
    return gate_rows(spark, sf).withColumn("position", F.col("position").cast("long"))


@query("fld_5_decisions", f"""WITH {GATES}
SELECT request_id, count(*) FILTER (WHERE passed) AS passed_gates, bool_and(passed) AS eligible,
  arg_min(gate_key, position) FILTER (WHERE NOT passed) AS first_failure,
  coalesce(arg_min(reason_code, position) FILTER (WHERE NOT passed), 'ok') AS reason_code,
  CASE WHEN bool_and(passed) THEN 'previewed' ELSE 'rejected' END AS status
FROM judged GROUP BY request_id""")
def fld_5_decisions(spark, sf):
    return G.decide(context(spark, sf))


@query("srt_9_request_detail", f"""WITH {GATES},
lines AS (SELECT request_id, string_agg(gate_key || '=' || reason_code, ';' ORDER BY position)
    AS gate_results FROM judged GROUP BY request_id)
SELECT request_id, '[redacted]' AS target_value, gate_results,
  CASE WHEN status = 'simulated' THEN request_id * 10 END AS execution_id,
  CASE WHEN status = 'simulated' AND request_id % 4 = 0
    THEN epoch_us(created_at + INTERVAL 1 DAY) END AS rolled_back_us
FROM requests JOIN lines USING (request_id)""")
def srt_9(spark, sf):
    r = B.requests(spark, sf)
    acts = r.where("status = 'simulated'").select(
        "request_id", (F.col("request_id") * 10).alias("execution_id"), "created_at")
    backs = acts.where("request_id % 4 = 0").select(
        "execution_id", (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return G.request_detail(r, gate_rows(spark, sf), acts, backs).select(
        "request_id", "target_value", F.concat_ws(";", "gate_results").alias("gate_results"),
        "execution_id", B.micros("rolled_back_at").alias("rolled_back_us"))


@query("fld_3_expired_requests", f"""WITH {B.REQUESTS}
SELECT CASE WHEN status = 'simulated' AND expires_at <= TIMESTAMP '1998-08-02' THEN 'expired'
  ELSE status END AS status, count(*) AS n FROM requests GROUP BY 1""")
def fld_3(spark, sf):
    return WF.expire_requests(B.requests(spark, sf), B.ORDERS_NOW).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))
