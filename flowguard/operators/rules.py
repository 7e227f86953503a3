"""Threshold rules over fixed event-time buckets.

Every evaluator is an aggregation in two steps. The first works on keys as fine
as (group, port, event), so a source with a third of all rows is spread over many
tasks; the second adds up small partial rows. Evidence stays a table of its own,
one row per (match, event), and a match holds its size and digest.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from flowguard import constants as K
from flowguard.functions.flow_columns import bucket, is_failure
from flowguard.functions.hashing import (LANES, lane_sums, lane_totals, lane_values,
                                         lanes_to_digest)


@dataclass(frozen=True)
class RuleSpec:
    """One rule version."""

    rule_key: str
    evaluator_key: str
    category: str
    severity: str
    window_seconds: int
    threshold: int
    failure_states: tuple = ()
    excluded_asset_ids: tuple = ()
    version_id: str = "1"
    active: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    def check(self) -> "RuleSpec":
        """Unknown evaluators and parameters out of bounds are errors."""
        if self.evaluator_key not in EVALUATORS:
            raise ValueError("unknown evaluator")
        low, high = THRESHOLD_BOUNDS[self.evaluator_key]
        if not low <= self.threshold <= high or self.extra or self.window_seconds < 1:
            raise ValueError("invalid rule parameters")
        if self.evaluator_key == "repeated_failure_v1" and not 1 <= len(self.failure_states) <= 32:
            raise ValueError("invalid rule parameters")
        if len(self.excluded_asset_ids) > 100:
            raise ValueError("invalid rule parameters")
        return self


# Smallest and largest threshold per evaluator.
THRESHOLD_BOUNDS = {
    "port_scan_v1": (2, 65_536),
    "repeated_failure_v1": (2, 10_000),
    "high_connection_rate_v1": (2, 100_000),
}

GROUPS = {
    "port_scan_v1": ["src_address", "dst_address"],
    "repeated_failure_v1": ["src_address", "dst_address", "dst_port", "protocol"],
    "high_connection_rate_v1": ["src_address"],
}

# The initial rule set.
DEFAULT_RULES = (
    RuleSpec("behavior.port_scan", "port_scan_v1", "reconnaissance", "medium", 60, 20),
    RuleSpec("behavior.repeated_failure", "repeated_failure_v1", "connection_failure", "low",
             300, 10, K.FAILURE_STATES),
    RuleSpec("behavior.high_connection_rate", "high_connection_rate_v1", "traffic_rate",
             "medium", 60, 100),
)

MATCH_COLUMNS = ["rule_key", "rule_version_id", "category", "severity", "bucket_start",
                 "bucket_end", "window_seconds", "sensor_id", "src_address", "dst_address",
                 "dst_port", "protocol", "observed_value", "threshold_value", "evidence_count",
                 "evidence_digest"]


def group_columns(rule: RuleSpec) -> list[str]:
    return ["bucket_start", "sensor_id", *GROUPS[rule.evaluator_key]]


def considered(flows: DataFrame, rule: RuleSpec) -> DataFrame:
    """Flows the rule looks at, with their bucket."""
    rows = flows
    if rule.evaluator_key == "port_scan_v1":
        rows = rows.where(F.col("dst_port").isNotNull())
    elif rule.evaluator_key == "repeated_failure_v1":
        rows = rows.where(F.col("dst_port").isNotNull() & is_failure(
            F.col("source_type"), F.col("state"), rule.failure_states))
    return rows.withColumn("bucket_start", bucket(F.col("event_time"), rule.window_seconds))


def _shape(counted: DataFrame, rule: RuleSpec, observed: Column) -> DataFrame:
    """Common columns of a match out of per-group totals."""
    held = set(GROUPS[rule.evaluator_key])
    end = F.timestamp_micros(F.unix_micros("bucket_start") + rule.window_seconds * 1_000_000)
    types = {"dst_address": "string", "dst_port": "int", "protocol": "string"}
    return (counted.withColumn("observed_value", observed.cast("long"))
            .where(F.col("observed_value") >= rule.threshold)
            .select(
                F.lit(rule.rule_key).alias("rule_key"),
                F.lit(rule.version_id).alias("rule_version_id"),
                F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"),
                "bucket_start", end.alias("bucket_end"),
                F.lit(rule.window_seconds).alias("window_seconds"), "sensor_id", "src_address",
                *[(F.col(c) if c in held else F.lit(None).cast(t)).alias(c)
                  for c, t in types.items()],
                "observed_value", F.lit(rule.threshold).cast("long").alias("threshold_value"),
                F.col("n").alias("evidence_count"),
                lanes_to_digest(F.col("n")).alias("evidence_digest")))


def port_scan(flows: DataFrame, rule: RuleSpec, unique: bool = False) -> DataFrame:
    """Many distinct destination ports of one pair of hosts in one bucket."""
    keys = group_columns(rule)
    rows = considered(flows, rule).select(*keys, "dst_port", "event_key")
    if not unique:
        rows = rows.distinct()
    per_port = rows.groupBy(*keys, "dst_port").agg(F.count(F.lit(1)).alias("n"),
                                                   *lane_sums(F.col("event_key")))
    counted = per_port.groupBy(*keys).agg(F.count(F.lit(1)).alias("ports"),
                                          F.sum("n").alias("n"), *lane_totals())
    return _shape(counted, rule, F.col("ports"))


def _event_count(flows: DataFrame, rule: RuleSpec, unique: bool) -> DataFrame:
    keys = group_columns(rule)
    rows = considered(flows, rule).select(*keys, "event_key")
    if not unique:
        rows = rows.distinct()
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                      *lane_sums(F.col("event_key")))
    return _shape(counted, rule, F.col("n"))


def repeated_failure(flows: DataFrame, rule: RuleSpec, unique: bool = False) -> DataFrame:
    """Many failed connections to one service in one bucket."""
    return _event_count(flows, rule, unique)


def high_rate(flows: DataFrame, rule: RuleSpec, unique: bool = False) -> DataFrame:
    """Many flows of one source in one bucket."""
    return _event_count(flows, rule, unique)


EVALUATORS = {
    "port_scan_v1": port_scan,
    "repeated_failure_v1": repeated_failure,
    "high_connection_rate_v1": high_rate,
}


def evidence(flows: DataFrame, rule: RuleSpec, matches: DataFrame) -> DataFrame:
    """The distinct events behind each match, one row per (match, event)."""
    keys = group_columns(rule)
    rows = considered(flows, rule).select(*keys, "event_key").distinct()
    hits = matches.where(F.col("rule_key") == rule.rule_key)
    side = hits.select(*[F.col(k).alias(f"_{k}") for k in keys], "rule_key")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "sensor_id" else F.col(k) == F.col(f"_{k}")
          for k in keys]
    return rows.join(side, on).select("rule_key", *keys, "event_key")


def exclude_assets(flows: DataFrame, assets: DataFrame | None, asset_ids) -> DataFrame:
    """Flows without the sources a rule leaves out; assets lacking an address exclude none.

    At most 100 assets can be named by a rule, which bounds the small side.
    """
    if not asset_ids:
        return flows
    if assets is None:
        raise ValueError("a rule leaves assets out, but no assets are given")
    sources = (assets.where(F.col("asset_id").isin(*asset_ids) & F.col("address").isNotNull())
               .select(F.col("address").alias("src_address")).distinct())
    return flows.join(sources, "src_address", "left_anti")


def touched_flows(all_flows: DataFrame, batch: DataFrame, window_seconds: int) -> DataFrame:
    """All flows of those buckets that a new batch falls into."""
    width = int(window_seconds)
    touched = batch.select(bucket(F.col("event_time"), width).alias("_bucket")).distinct()
    return (all_flows.withColumn("_bucket", bucket(F.col("event_time"), width))
            .join(touched, "_bucket", "left_semi").drop("_bucket"))


def _in_one_pass(flows: DataFrame, rules, unique: bool) -> DataFrame:
    """Matches of several rules from one scan and one pair of shuffles.

    A flow gives one row per rule that considers it; from there on the rule is part of the key.
    """
    def choose(values):
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule"))

    def seen_by(i, rule):
        held = GROUPS[rule.evaluator_key]
        applies = F.lit(True)
        if rule.evaluator_key == "port_scan_v1":
            applies = F.col("dst_port").isNotNull()
        elif rule.evaluator_key == "repeated_failure_v1":
            applies = F.col("dst_port").isNotNull() & is_failure(
                F.col("source_type"), F.col("state"), rule.failure_states)
        scan = rule.evaluator_key == "port_scan_v1"
        none = F.lit(None)
        return F.when(applies, F.struct(
            F.lit(i).alias("rule"),
            bucket(F.col("event_time"), rule.window_seconds).alias("bucket_start"),
            (F.col("dst_address") if "dst_address" in held else none.cast("string"))
            .alias("dst_address"),
            (F.col("dst_port") if "dst_port" in held else none.cast("int")).alias("dst_port"),
            (F.col("protocol") if "protocol" in held else none.cast("string")).alias("protocol"),
            (F.col("dst_port") if scan else none.cast("int")).alias("port")))
    lanes = [f"_v{i}" for i in range(LANES)]
    wide = flows.select("*", *[v.alias(n) for v, n in zip(lane_values(F.col("event_key")), lanes)]
                        ) if unique else flows
    rows = wide.select("sensor_id", "src_address", "event_key", *(lanes if unique else ()), F.explode(
        F.array_compact(F.array(*[seen_by(i, r) for i, r in enumerate(rules)]))).alias("r"))
    keys = ["rule", "bucket_start", "sensor_id", "src_address", "dst_address", "dst_port",
            "protocol"]
    rows = rows.select("event_key", *(lanes if unique else ()), "sensor_id", "src_address", "r.*")
    if not unique:
        rows = rows.distinct()
    per_port = rows.groupBy(*keys, "port").agg(
        F.count(F.lit(1)).alias("n"), *lane_sums(
            F.col("event_key"), values=[F.col(n) for n in lanes] if unique else None))
    counted = per_port.groupBy(*keys).agg(F.count(F.lit(1)).alias("ports"),
                                          F.sum("n").alias("n"), *lane_totals())
    scans = choose([r.evaluator_key == "port_scan_v1" for r in rules])
    seconds = choose([r.window_seconds for r in rules])
    threshold = choose([r.threshold for r in rules])
    found = counted.withColumn("observed_value", F.when(scans, F.col("ports")).otherwise(
        F.col("n")).cast("long")).where(F.col("observed_value") >= threshold)
    return found.select(
        choose([r.rule_key for r in rules]).alias("rule_key"),
        choose([r.version_id for r in rules]).alias("rule_version_id"),
        choose([r.category for r in rules]).alias("category"),
        choose([r.severity for r in rules]).alias("severity"), "bucket_start",
        F.timestamp_micros(F.unix_micros("bucket_start") + seconds.cast("long") * 1_000_000)
        .alias("bucket_end"), seconds.alias("window_seconds"), "sensor_id", "src_address",
        "dst_address", "dst_port", "protocol", "observed_value",
        threshold.cast("long").alias("threshold_value"), F.col("n").alias("evidence_count"),
        lanes_to_digest(F.col("n")).alias("evidence_digest")).select(*MATCH_COLUMNS)


def evaluate_rules(flows: DataFrame, rules, assets: DataFrame | None = None,
                   batch: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Matches of all active rules. With ``batch`` only the buckets it touches count.

    A rule that leaves assets out needs the table of assets. Rules that see the same flows share
    one scan: those without exclusions and, with a batch, of the same window.
    """
    shared: dict = {}
    for rule in sorted((r for r in rules if r.active), key=lambda r: r.rule_key):
        rule.check()
        window = None if batch is None else rule.window_seconds
        shared.setdefault((window, tuple(rule.excluded_asset_ids)), []).append(rule)
    if not shared:
        raise ValueError("no active rules")
    out = None
    for (window, excluded), group in shared.items():
        rows = flows if window is None else touched_flows(flows, batch, window)
        part = _in_one_pass(exclude_assets(rows, assets, excluded), group, unique)
        out = part if out is None else out.unionByName(part)
    return out


def rule_set_hash(rules) -> str:
    """Identity of the active rule set."""
    import hashlib
    import json
    rows = [[r.rule_key, r.version_id, r.evaluator_key, r.window_seconds, r.threshold,
             list(r.failure_states), list(r.excluded_asset_ids)]
            for r in sorted(rules, key=lambda r: r.rule_key) if r.active]
    return hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest()
