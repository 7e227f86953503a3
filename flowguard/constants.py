"""Vocabularies, bounds, policies and feature names.

Everything in this module is a fixed value of the data contracts and has to
stay as it is for results to keep their meaning.
"""

# --- flow contract -------------------------------------------------------
FLOW_SCHEMA_VERSION = "1"
SIGNATURE_SCHEMA_VERSION = "signature-event/v1"
SOURCE_TYPES = ("normalized", "zeek", "suricata", "pcap")
MAX_LINE_BYTES = 65_536
MAX_PORT = 65_535
MAX_DURATION_MS = 604_800_000
MAX_INT64 = 9_223_372_036_854_775_807
MAX_INT32 = 2_147_483_647
PROTOCOL_PATTERN = "^[a-z0-9]{1,16}$"
STATE_PATTERN = "^[A-Za-z0-9_.-]{1,32}$"

# --- reject codes --------------------------------------------------------
LINE_TOO_LONG = "line_too_long"
EMPTY_RECORD = "empty_record"
INVALID_RECORD = "invalid_record"
UNSUPPORTED_PACKET = "unsupported_packet"
ALL_RECORDS_REJECTED = "all_records_rejected"

# --- detection -----------------------------------------------------------
FAILURE_STATES = ("REJ", "S0", "RSTO", "RSTR", "SH", "SHR")
UNSPECIFIED_SENSOR = "unspecified"
SIGNATURE_WINDOW_SECONDS = 60
MAX_EVIDENCE_PER_ALERT = 100
ALERT_FINGERPRINT_SCHEMA = "alert-fingerprint/v1"
EVIDENCE_SCHEMA = "alert-evidence/v1"
DETERMINISTIC_SOURCES = ("behavioral_rule", "suricata_signature")
REPORTED_SEVERITY = {1: "high", 2: "medium", 3: "low"}
CORRELATION_VERSION = "incident-correlation/v1"
CORRELATION_WINDOW_DAYS = 30

# --- features ------------------------------------------------------------
MISSING_TOKEN = "__MISSING__"
UNKNOWN_TOKEN = "__UNKNOWN__"
RATE_CAP = 1_000_000_000_000.0
PORT_CLASSES = ("none", "well_known", "registered", "dynamic")
PROTOCOL_VOCABULARY = (
    MISSING_TOKEN, UNKNOWN_TOKEN, "tcp", "udp", "icmp", "icmpv6", "gre", "esp",
)
STATE_VOCABULARY = (
    MISSING_TOKEN, UNKNOWN_TOKEN, "REJ", "S0", "S1", "SF", "RSTO", "RSTR", "SH", "SHR", "OTH",
)
DIRECT_FEATURES = (
    "duration_ms", "packet_count", "byte_count", "src_port_present", "dst_port_present",
    "src_port", "dst_port", "src_port_class", "dst_port_class", "protocol",
    "connection_state", "bytes_per_packet", "packets_per_second", "bytes_per_second",
    "zero_duration", "zero_packets", "rate_clipped",
)
WINDOW_FEATURES = (
    "flow_count", "unique_dst_address_count", "unique_dst_port_count", "packet_total",
    "byte_total", "failure_count", "mean_duration_ms", "max_duration_ms",
    "mean_bytes_per_flow", "seconds_since_prior_service", "prior_service_missing",
)
DEFAULT_WINDOWS = (60, 300)
CATEGORY_VOCABULARIES = {
    "src_port_class": PORT_CLASSES,
    "dst_port_class": PORT_CLASSES,
    "protocol": PROTOCOL_VOCABULARY,
    "connection_state": STATE_VOCABULARY,
}
BOOLEAN_FEATURES = (
    "src_port_present", "dst_port_present", "zero_duration", "zero_packets", "rate_clipped",
    "w60_prior_service_missing", "w300_prior_service_missing",
)
PROVENANCE_COLUMNS = (
    "event_key", "cutoff_time", "schema_hash", "schema_version", "snapshot_hash",
    "vector_hash", "quality_flags",
)
FEATURE_SCHEMA_VERSION = "1.0.0"
BANNED_MODEL_COLUMNS = (
    "label", "attack_cat", "row_id", "event_key", "source_event_id", "job_id", "sensor_id",
    "src_address", "dst_address", "event_time", "alert", "rule_match", "severity", "risk",
    "confidence", "incident", "prevention", "split", "source_filename",
)


def feature_names(windows=DEFAULT_WINDOWS) -> tuple:
    """The ordered model columns: direct features, then each window's features."""
    return DIRECT_FEATURES + tuple(f"w{w}_{name}" for w in windows for name in WINDOW_FEATURES)


# --- splits --------------------------------------------------------------
PARTITIONS = ("training", "validation", "test")
SPLIT_SHARES = (0.70, 0.15, 0.15)
SPLIT_TOLERANCE = 0.05

# --- fusion --------------------------------------------------------------
FUSION_WEIGHTS = {
    "signature": 0.40, "behavioral_rule": 0.30, "supervised": 0.20, "anomaly": 0.10,
}
FUSION_PRECEDENCE = ("signature", "behavioral_rule", "supervised", "anomaly")
FUSION_QUALITIES = ("valid", "absent", "stale", "incompatible")
SEVERITY_BANDS = (
    ("informational", 0, 24), ("low", 25, 49), ("medium", 50, 74), ("high", 75, 89),
    ("critical", 90, 100),
)
CONFIDENCE_DENOMINATOR = 3
DEFAULT_CATEGORY = "unusual_behavior"

# --- workflow ------------------------------------------------------------
ALERT_TRANSITIONS = {
    "new": ("acknowledged",),
    "acknowledged": ("investigating", "closed"),
    "investigating": ("closed",),
    "closed": ("investigating",),
}
INCIDENT_TRANSITIONS = {
    "open": ("investigating",),
    "investigating": ("resolved",),
    "resolved": ("closed", "investigating"),
    "closed": ("investigating",),
}
REQUEST_TRANSITIONS = {
    "draft": ("evaluated",),
    "evaluated": ("rejected", "previewed"),
    "rejected": (),
    "previewed": ("simulated",),
    "simulated": ("expired", "rolled_back"),
    "expired": (),
    "rolled_back": (),
}
REQUEST_TERMINAL = ("rejected", "expired", "rolled_back")
DISPOSITIONS = ("false_positive", "benign", "synthetic_true_positive")
NOTE_MAX_BYTES = 4096
REDACTED_ENDPOINT = "[redacted-endpoint]"
IPV4_IN_TEXT = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6_IN_TEXT = r"\b[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}\b"

# --- policy gates --------------------------------------------------------
GATE_ORDER = (
    "environment", "authorization", "target_validity", "internal_external", "allowlist",
    "critical_asset", "evidence", "model_anomaly_only", "intelligence_freshness", "duration",
    "rollback", "duplicate_replay", "rate_cooldown",
)
SIMULATION_MODE = "simulation"
POLICY_MAX_DURATION_SECONDS = 86_400
TARGET_SCOPES = {
    "external_ip": "external", "external_domain": "external", "internal_ip": "internal",
}
INTERNAL_V4_BLOCKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16",
)
INTERNAL_V6_BLOCKS = ("::1/128", "fc00::/7", "fe80::/10")
HOSTNAME_PATTERN = (
    r"^(?=.{1,253}$)(?!-)[A-Za-z0-9-]{1,63}(?:\.(?!-)[A-Za-z0-9-]{1,63})+$"
)
REDACTED_TARGET = "[redacted]"

# --- monitoring ----------------------------------------------------------
METRIC_KEYS = (
    "row_count", "group_count", "missing_rate", "unseen_rate", "range_failure_rate",
    "duplicate_rate", "score_mean", "score_stddev", "positive_rate", "latency_ms_p50",
    "latency_ms_p95",
)
SLI_KEYS = (
    "api_request_count", "api_latency_ms_p50", "api_latency_ms_p95", "api_error_count",
    "queue_depth", "queue_age_seconds_p95", "task_success_count", "task_failure_count",
    "task_not_evaluable_count", "monitoring_stale_count", "monitoring_hash_mismatch_count",
    "feedback_unresolved_count", "artifact_integrity_failure_count",
    "retention_cleanup_success_count", "retention_cleanup_failure_count",
    "backup_restore_success_count", "backup_restore_failure_count", "readiness_failure_count",
)
SLI_DIMENSIONS = (
    "component", "operation", "status", "source_kind", "report_type", "task_name", "role_class",
)
OBSERVABILITY_STATUSES = ("succeeded", "failed", "degraded", "not_evaluable")
REPORT_TYPES = (
    "synthetic_quality_drift", "synthetic_feedback_summary", "synthetic_operations",
    "synthetic_retention_recovery", "synthetic_gate_evidence",
)
MINIMUM_SAMPLES = 30
WARNING_DELTA = 0.20
CRITICAL_DELTA = 0.50

# --- retention and quotas -------------------------------------------------
FLOW_RETENTION_DAYS = 30
ALERT_RETENTION_DAYS = 180
MAX_BATCHES_IN_FLIGHT = 3

# --- models ---------------------------------------------------------------
SEED = 20260714
FOREST_TREES = 100
FOREST_ROWS = 256
ATTRIBUTION_EPSILON = 1e-9

# Words a summary of an explanation must not use.
CAUSAL_WORDS = ("cause", "causes", "caused", "proves", "proof", "malicious", "attacker",
                "guarantee", "guaranteed")
