"""Policy gates over proposed actions and the facts they need."""

from pyspark.sql import Column, DataFrame, functions as F

from flowguard import constants as K
from flowguard.functions.network import is_valid_target, target_scope


TARGET = ["target_type", "target_value"]


def with_allowlist(requests: DataFrame, allow: DataFrame, now) -> DataFrame:
    """Adds ``allowlist_match``; entries without an expiry never end."""
    live = allow.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))) \
        .select(*TARGET, F.lit(True).alias("_hit")).distinct()
    return requests.join(live, TARGET, "left").withColumn(
        "allowlist_match", F.coalesce("_hit", F.lit(False))).drop("_hit")


def with_critical(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds ``target_is_critical``: the target is an active asset of critical importance."""
    critical = assets.where(F.col("is_active") & (F.col("criticality") == "critical")
                            & F.col("address").isNotNull()) \
        .select(F.col("address").alias("target_value"), F.lit(True).alias("_hit")).distinct()
    return requests.join(critical, "target_value", "left").withColumn(
        "target_is_critical", F.coalesce("_hit", F.lit(False))).drop("_hit")


def allowlisted(requests: DataFrame, allow: DataFrame, now) -> DataFrame:
    """Requests whose target is on the list."""
    return with_allowlist(requests, allow, now).where("allowlist_match")


def critical_target(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Requests against a critical asset."""
    return with_critical(requests, assets).where("target_is_critical")


def look_up(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join on a key that many rows don't have.

    Rows without it are spread over all tasks by a salt; rows with it, and the other side, have the
    salt nought.
    """
    none = F.col(key).isNull()
    salted = rows.withColumn("_salt", F.when(none, F.pmod(
        F.xxhash64("request_id"), F.lit(4096))).otherwise(F.lit(0)))
    # Not a literal, which the optimizer would take out of the join's keys.
    nought = F.pmod(F.xxhash64(key), F.lit(1))
    return salted.join(side.withColumn("_salt", nought), [key, "_salt"], "left").drop("_salt")


def with_evidence(requests: DataFrame, alerts: DataFrame, incidents: DataFrame,
                  members: DataFrame) -> DataFrame:
    """Adds: evidence present, corroborated by a deterministic source, model only.

    Incidents are reduced to one row each before requests look them up.
    """
    sure = F.col("source_type").isin(*K.DETERMINISTIC_SOURCES)
    per_alert = alerts.select("alert_id", sure.alias("_alert_sure"))
    per_incident = (incidents.select("incident_id")
                    .join(members.join(alerts, "alert_id")
                          .groupBy("incident_id").agg(F.bool_or(sure).alias("_sure")),
                          "incident_id", "left")
                    .select("incident_id", F.coalesce("_sure", F.lit(False))
                            .alias("_incident_sure")))
    rows = look_up(look_up(requests, per_alert, "alert_id"), per_incident, "incident_id")
    no = F.lit(False)
    present = F.col("_alert_sure").isNotNull() | F.col("_incident_sure").isNotNull()
    return (rows.withColumn("evidence_present", present)
            .withColumn("corroborated", F.coalesce("_alert_sure", no)
                        | F.coalesce("_incident_sure", no))
            .withColumn("model_only", F.col("evidence_present") & ~F.col("corroborated"))
            .drop("_alert_sure", "_incident_sure"))


def evidence_flags(requests: DataFrame, alerts: DataFrame, incidents: DataFrame,
                   members: DataFrame) -> DataFrame:
    return with_evidence(requests, alerts, incidents, members).select(
        "request_id", "evidence_present", "corroborated", "model_only")


def with_intelligence(requests: DataFrame, indicators: DataFrame, now) -> DataFrame:
    """Adds: an indicator is used, it is the only proof, it is fresh."""
    side = indicators.select("indicator_id", F.col("expires_at").alias("_until"))
    used = F.col("_until").isNotNull()
    return (look_up(requests, side, "indicator_id")
            .withColumn("intelligence_used", used)
            .withColumn("intelligence_sole", used & ~F.col("corroborated"))
            .withColumn("intelligence_fresh", F.coalesce(F.col("_until") > F.lit(now),
                                                         F.lit(True))).drop("_until"))


def intelligence_flags(requests: DataFrame, indicators: DataFrame, now) -> DataFrame:
    return with_intelligence(requests, indicators, now).select(
        "request_id", "intelligence_used", "intelligence_sole", "intelligence_fresh")


def with_replay(requests: DataFrame, cooldown_seconds: int) -> DataFrame:
    """Adds: an earlier open request of the same kind, and one within the cooldown.

    Both come from minima and maxima per key (and time bucket as wide as the cooldown),
    never from comparing requests of a target with each other.
    """
    order = F.struct("created_at", "request_id")
    t = F.unix_micros("created_at")
    width = F.lit(cooldown_seconds * 1_000_000)
    base = requests.withColumn("_at", order).withColumn("_slot", t - F.pmod(t, width))
    opened = (requests.where(~F.col("status").isin(*K.REQUEST_TERMINAL))
              .groupBy("action_type", *TARGET).agg(F.min(order).alias("_first_open")))
    slots = base.groupBy(*TARGET, "_slot").agg(F.min("_at").alias("_slot_first"),
                                               F.max("created_at").alias("_last"))
    # A slot speaks to its own requests and to those of the next one.
    spoken = slots.select(*TARGET, F.explode(F.array(
        F.struct("_slot", "_slot_first", F.lit(None).cast("timestamp").alias("_before")),
        F.struct((F.col("_slot") + width).alias("_slot"), F.lit(None).cast(
            slots.schema["_slot_first"].dataType).alias("_slot_first"),
            F.col("_last").alias("_before")))).alias("s")).select(*TARGET, "s.*")
    near = spoken.groupBy(*TARGET, "_slot").agg(F.min("_slot_first").alias("_slot_first"),
                                                F.max("_before").alias("_before"))
    no = F.lit(False)
    return (base.join(near, [*TARGET, "_slot"], "left")
            .join(opened, ["action_type", *TARGET], "left")
            .withColumn("duplicate_detected", F.coalesce(F.col("_first_open") < F.col("_at"), no))
            .withColumn("cooldown_active", F.coalesce(F.col("_slot_first") < F.col("_at"), no)
                        | F.coalesce(F.unix_micros("_before") >= t - width, no))
            .drop("_at", "_slot", "_slot_first", "_before", "_first_open"))


def replay_flags(requests: DataFrame, cooldown_seconds: int) -> DataFrame:
    return with_replay(requests, cooldown_seconds).select("request_id", "duplicate_detected",
                                                          "cooldown_active")


def gate_context(requests: DataFrame, allow: DataFrame, assets: DataFrame, alerts: DataFrame,
                 incidents: DataFrame, members: DataFrame, indicators: DataFrame, now,
                 cooldown_seconds: int = 3600) -> DataFrame:
    """Requests with every fact the gates ask for; each fact is one look-up."""
    rows = with_evidence(with_replay(requests, cooldown_seconds), alerts, incidents, members)
    rows = with_intelligence(rows, indicators, now)
    return with_critical(with_allowlist(rows, allow, now), assets)


# Reasons that do not stop a request.
PASSING = ("ok", "intelligence_stale_ignored")


def gate_array(max_seconds: int = K.POLICY_MAX_DURATION_SECONDS) -> Column:
    """All thirteen gates of a request context, in gate order, as one array."""
    scope = target_scope(F.col("target_type"))
    seconds, fine = F.col("duration_seconds"), F.lit("ok")
    # reason per gate; a gate passes when its reason is in `passing`
    reasons = {
        "environment": F.when(F.col("environment") == K.SIMULATION_MODE, fine)
        .otherwise("environment_not_simulation"),
        "authorization": F.when(F.col("has_permission"), fine)
        .otherwise("missing_simulation_permission"),
        "target_validity": F.when(
            is_valid_target(F.col("target_type"), F.col("target_value")), fine)
        .otherwise("target_not_canonical"),
        "internal_external": F.when(scope == "unknown", "scope_unknown")
        .when(scope == "internal", "internal_stricter_denial").otherwise(fine),
        "allowlist": F.when(F.col("allowlist_match"), "target_allowlisted").otherwise(fine),
        "critical_asset": F.when(F.col("target_is_critical"), "critical_asset_denied")
        .otherwise(fine),
        "evidence": F.when(~F.col("evidence_present"), "evidence_missing")
        .when(~F.col("corroborated"), "evidence_not_corroborated").otherwise(fine),
        "model_anomaly_only": F.when(F.col("model_only"), "model_or_anomaly_only")
        .otherwise(fine),
        "intelligence_freshness": F.when(~F.col("intelligence_used"), fine)
        .when(F.col("intelligence_sole"), "intelligence_sole_proof")
        .when(~F.col("intelligence_fresh"), "intelligence_stale_ignored").otherwise(fine),
        "duration": F.when(seconds <= 0, "duration_not_positive")
        .when(seconds > max_seconds, "duration_exceeds_policy_max")
        .when(~F.col("has_expiry"), "expiry_missing").otherwise(fine),
        "rollback": F.when(F.col("has_rollback_plan"), fine).otherwise("rollback_plan_missing"),
        "duplicate_replay": F.when(F.col("duplicate_detected"), "duplicate_request")
        .otherwise(fine),
        "rate_cooldown": F.when(F.col("cooldown_active"), "cooldown_active").otherwise(fine),
    }
    return F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(g).alias("gate_key"),
                              reasons[g].alias("reason_code"))
                     for i, g in enumerate(K.GATE_ORDER)])


def evaluate_gates(ctx: DataFrame,
                   max_seconds: int = K.POLICY_MAX_DURATION_SECONDS) -> DataFrame:
    """Thirteen rows per request, in gate order; every gate is always evaluated."""
    return (ctx.select("request_id", F.explode(gate_array(max_seconds)).alias("g"))
            .select("request_id", "g.position", "g.gate_key",
                    F.col("g.reason_code").isin(*PASSING).alias("passed"), "g.reason_code"))


def decide(ctx: DataFrame,
           max_seconds: int = K.POLICY_MAX_DURATION_SECONDS) -> DataFrame:
    """Per request: eligible only if all gates pass; the first failure is kept.

    Gates are judged inside the row, so nothing is shuffled.
    """
    rows = ctx.select("request_id", gate_array(max_seconds).alias("_g")).select(
        "request_id", F.filter("_g", lambda g: ~g["reason_code"].isin(*PASSING)).alias("_bad"))
    first = F.get("_bad", F.lit(0))
    fine = F.size("_bad") == 0
    return rows.select(
        "request_id", (F.lit(len(K.GATE_ORDER)) - F.size("_bad")).cast("long")
        .alias("passed_gates"), fine.alias("eligible"), first["gate_key"].alias("first_failure"),
        F.coalesce(first["reason_code"], F.lit("ok")).alias("reason_code"),
        F.when(fine, "previewed").otherwise("rejected").alias("status"))


def decisions(gates: DataFrame) -> DataFrame:
    """The same decision out of stored gate rows."""
    failed = F.when(~F.col("passed"), F.struct("position", "gate_key", "reason_code"))
    rows = gates.groupBy("request_id").agg(F.count_if("passed").alias("passed_gates"),
                                           F.min(failed).alias("_first"))
    return rows.select("request_id", "passed_gates", F.col("_first").isNull().alias("eligible"),
                       F.col("_first.gate_key").alias("first_failure"),
                       F.coalesce("_first.reason_code", F.lit("ok")).alias("reason_code"),
                       F.when(F.col("_first").isNull(), "previewed").otherwise("rejected")
                       .alias("status"))


def request_detail(requests: DataFrame, gates: DataFrame, executions: DataFrame,
                   rollbacks: DataFrame, sensitive: bool = False) -> DataFrame:
    """Requests with their gate rows in order (thirteen each), execution and rollback."""
    shown = F.col("target_value") if sensitive else F.lit(K.REDACTED_TARGET)
    lines = gates.groupBy("request_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "gate_key", "reason_code"))),
        lambda g: F.concat(g["gate_key"], F.lit("="), g["reason_code"])).alias("gate_results"))
    acts = executions.select("request_id", "execution_id",
                             F.col("created_at").alias("executed_at"))
    backs = rollbacks.select("execution_id", F.col("created_at").alias("rolled_back_at"))
    return (requests.withColumn("target_value", shown).join(lines, "request_id", "left")
            .join(acts, "request_id", "left").join(backs, "execution_id", "left"))
