"""Row contracts as boolean columns. Null never comes out: a row is good or not."""

from pyspark.sql import Column, functions as F

from flowguard import constants as K


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _optional(c: Column, ok: Column) -> Column:
    return c.isNull() | _true(ok)


def _length(name: str, low: int, high: int) -> Column:
    return F.length(F.col(name)).between(low, high)


def _ports() -> Column:
    src, dst = F.col("src_port"), F.col("dst_port")
    return (_optional(src, src.between(0, K.MAX_PORT)) & _optional(dst, dst.between(0, K.MAX_PORT))
            & (src.isNull() == dst.isNull()))


def metadata_ok(c: Column) -> Column:
    keys = F.map_keys(c)
    return c.isNull() | (
        (F.size(c) <= 12)
        & F.forall(keys, lambda k: (F.length(k) <= 32) & k.rlike(r"^_*[\p{L}\p{N}][\p{L}\p{N}_]*$"))
        & F.forall(F.map_values(c), lambda v: F.coalesce(F.length(v) <= 128, F.lit(True))))


def flow_ok() -> Column:
    """The canonical flow contract over columns of the usual names."""
    source_id, state = F.col("source_event_id"), F.col("state")
    return (
        _true(F.col("schema_version") == K.FLOW_SCHEMA_VERSION)
        & _true(F.col("source_type").isin(*K.SOURCE_TYPES))
        & _optional(source_id, _length("source_event_id", 1, 128))
        & F.col("event_time").isNotNull()
        & _true(_length("src_address", 2, 45)) & _true(_length("dst_address", 2, 45))
        & _ports()
        & _true(F.col("protocol").rlike(K.PROTOCOL_PATTERN))
        & _true(F.col("duration_ms").between(0, K.MAX_DURATION_MS))
        & _true(F.col("packet_count") >= 0) & _true(F.col("byte_count") >= 0)
        & _optional(state, state.rlike(K.STATE_PATTERN))
        & _true(metadata_ok(F.col("metadata"))))


def signature_ok() -> Column:
    """The signature-event contract over columns of the usual names."""
    source_id, flow_id, action = (F.col("source_event_id"), F.col("flow_id"),
                                  F.col("reported_action"))
    control = r"[\x00-\x08\x0A-\x1F]"
    return (
        _true(F.col("schema_version") == K.SIGNATURE_SCHEMA_VERSION)
        & _optional(source_id, _length("source_event_id", 1, 128))
        & F.col("event_time").isNotNull()
        & _true(_length("src_address", 2, 45)) & _true(_length("dst_address", 2, 45))
        & _ports()
        & _true(F.col("protocol").rlike(K.PROTOCOL_PATTERN))
        & _true(F.col("signature_id").between(1, K.MAX_INT32))
        & _true(F.col("signature_revision").between(0, K.MAX_INT32))
        & _true(_length("signature_name", 1, 256)) & _true(~F.col("signature_name").rlike(control))
        & _true(_length("category", 1, 128)) & _true(~F.col("category").rlike(control))
        & _true(F.col("reported_severity").between(1, 255))
        & _optional(action, action.rlike(K.STATE_PATTERN))
        & _optional(flow_id, _length("flow_id", 1, 128)))


def indicator_ok() -> Column:
    """Indicator contract: times present and in order, confidence a share."""
    return (
        _true(F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()
              & F.col("expires_at").isNotNull())
        & _true(F.col("last_seen") >= F.col("first_seen"))
        & _true(F.col("expires_at") > F.col("first_seen"))
        & _true(F.col("confidence").between(0.0, 1.0))
        & _true(F.col("value_hash").rlike("^[a-f0-9]{64}$"))
        & _true(F.col("source_name").rlike("^[a-z0-9_.-]{1,64}$")))


def observability_ok() -> Column:
    """Observability-event contract; a failed event has an error code, others none."""
    error, has_error = F.col("error_code"), F.coalesce(F.col("error_code") != "", F.lit(False))
    return (
        _true(F.col("status").isin(*K.OBSERVABILITY_STATUSES))
        & _true((F.col("status") == "failed") == has_error)
        & _optional(error, error.rlike("^[a-z0-9_.-]{1,64}$"))
        & _true(F.col("component").rlike("^[a-z0-9_.-]{1,32}$"))
        & _true(F.col("operation").rlike("^[a-z0-9_.-]{1,64}$"))
        & _true(F.col("duration_ms").between(0, 300_000))
        & _true(F.col("rows").between(0, 100_000))
        & _true(F.col("groups").between(0, 10_000))
        & _true(F.col("tasks").between(0, 10_000))
        & _true(F.col("bytes").between(0, 67_108_864)))


def fusion_input_ok() -> Column:
    """A valid signal has evidence and a category; scores are shares."""
    return (
        _true(F.col("score").between(0.0, 1.0))
        & _true(F.col("source").isin(*K.FUSION_PRECEDENCE))
        & _true(F.col("quality").isin(*K.FUSION_QUALITIES))
        & ((F.col("quality") != "valid")
           | (F.col("evidence_hash").isNotNull() & F.col("category").isNotNull())))


def allowed_metric(c: Column) -> Column:
    return _true(c.isin(*K.METRIC_KEYS))


def allowed_sli(metric: Column, dimension: Column) -> Column:
    return _true(metric.isin(*K.SLI_KEYS)) & _optional(dimension,
                                                      dimension.isin(*K.SLI_DIMENSIONS))
