"""The feature table: direct columns, window columns, provenance, matrix and sink."""

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from flowguard import constants as K
from flowguard.functions.flow_columns import bounded_rate, category, port_class, raw_rate
from flowguard.functions.hashing import iso_z
from flowguard.operators.digest import content_digest, set_digest
from flowguard.operators.windows import window_features

FLOW_INPUTS = ["event_key", "event_time", "sensor_id", "src_address", "dst_address", "src_port",
               "dst_port", "protocol", "duration_ms", "packet_count", "byte_count", "state",
               "source_type"]


def _rates() -> dict:
    duration = F.col("duration_ms") / F.lit(1000.0)
    return {
        "bytes_per_packet": (F.col("byte_count"), F.col("packet_count")),
        "packets_per_second": (F.col("packet_count"), duration),
        "bytes_per_second": (F.col("byte_count"), duration),
    }


def quality_flags() -> Column:
    """Names of the rates that hit the cap, in alphabetical order."""
    return F.array_compact(F.array(*[
        F.when(raw_rate(*pair) > K.RATE_CAP, F.lit(f"{name}_clipped"))
        for name, pair in sorted(_rates().items())]))


def direct_columns() -> list[Column]:
    """The 17 row-local features in their fixed order."""
    src, dst = F.col("src_port"), F.col("dst_port")
    values = {
        "duration_ms": F.col("duration_ms"), "packet_count": F.col("packet_count"),
        "byte_count": F.col("byte_count"), "src_port_present": src.isNotNull(),
        "dst_port_present": dst.isNotNull(),
        "src_port": F.coalesce(src, F.lit(0)).cast("long"),
        "dst_port": F.coalesce(dst, F.lit(0)).cast("long"),
        "src_port_class": port_class(src), "dst_port_class": port_class(dst),
        "protocol": category(F.col("protocol"), K.PROTOCOL_VOCABULARY),
        "connection_state": category(F.col("state"), K.STATE_VOCABULARY),
        **{name: bounded_rate(*pair) for name, pair in _rates().items()},
        "zero_duration": F.col("duration_ms") == 0, "zero_packets": F.col("packet_count") == 0,
        "rate_clipped": F.size(quality_flags()) > 0,
    }
    return [values[name].alias(name) for name in K.DIRECT_FEATURES]


def direct_features(flows: DataFrame) -> DataFrame:
    return flows.select("event_key", *direct_columns(), quality_flags().alias("quality_flags"))


def schema_hash(windows=K.DEFAULT_WINDOWS) -> str:
    """Identity of the ordered feature names and the windows."""
    text = json.dumps({"names": list(K.feature_names(windows)), "windows": list(windows),
                       "version": K.FEATURE_SCHEMA_VERSION}, separators=(",", ":"),
                      sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def as_text(df: DataFrame, name: str, decimals: int = 6) -> Column:
    """Value as text: floating numbers with a fixed number of decimals."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    return c.cast(f"decimal(38,{decimals})").cast("string") if kind in ("double", "float") \
        else c.cast("string")


def vector_text(df: DataFrame, names) -> Column:
    return F.concat_ws("|", *[F.coalesce(as_text(df, n), F.lit("null")) for n in names])


def near_key(df: DataFrame, names) -> Column:
    """Hash of a vector rounded to six decimals: equal for near-duplicates."""
    return F.sha2(vector_text(df, names), 256)


def snapshot_digest(flows: DataFrame) -> DataFrame:
    """Digest of the (event, sensor) pairs a feature table was made from."""
    pair = F.concat_ws("|", F.col("event_key"), F.coalesce("sensor_id", F.lit("")))
    return set_digest(flows, pair).select(F.col("digest").alias("snapshot_hash"))


def feature_columns(flows: DataFrame, windows=K.DEFAULT_WINDOWS,
                    slice_seconds: int | None = None, carry=()) -> DataFrame:
    """event_key, carry columns, cutoff time, quality flags and all feature columns.

    The row-local columns travel through the window computation, so the table is made
    with one shuffle and without joining features back.
    """
    names = K.feature_names(windows)
    direct = [c.alias(f"d_{n}") for c, n in zip(direct_columns(), K.DIRECT_FEATURES)]
    rows = flows.select("*", F.struct(*direct).alias("_direct"), quality_flags()
                        .alias("quality_flags"))
    extra = [c for c in carry if c not in FLOW_INPUTS]
    done = window_features(rows, windows, slice_seconds,
                           carry=("event_time", "_direct", "quality_flags", *extra))
    return done.select("event_key", *extra, F.col("event_time").alias("cutoff_time"),
                       "quality_flags",
                       *[F.col(f"_direct.d_{n}").alias(n) for n in K.DIRECT_FEATURES],
                       *names[len(K.DIRECT_FEATURES):])


def feature_table(flows: DataFrame, windows=K.DEFAULT_WINDOWS,
                  slice_seconds: int | None = None, carry=()) -> DataFrame:
    """Seven provenance columns and all feature columns, one row per flow."""
    names = K.feature_names(windows)
    extra = [c for c in carry if c not in FLOW_INPUTS]
    done = feature_columns(flows, windows, slice_seconds, carry)
    fixed = schema_hash(windows)
    vector = F.sha2(F.concat_ws(
        "|", F.lit(fixed), iso_z(F.col("cutoff_time")), vector_text(done, names),
        F.concat_ws(",", "quality_flags")), 256)
    snapshot = snapshot_digest(flows).scalar()
    return done.select(
        "event_key", "cutoff_time", F.lit(fixed).alias("schema_hash"),
        F.lit(K.FEATURE_SCHEMA_VERSION).alias("schema_version"),
        snapshot.alias("snapshot_hash"), vector.alias("vector_hash"), "quality_flags",
        *names, *extra)


def model_matrix(features: DataFrame, names=None) -> DataFrame:
    """Exactly the ordered model columns; leaking or missing columns are errors."""
    names = list(names or K.feature_names())
    if set(names) & set(K.BANNED_MODEL_COLUMNS):
        raise ValueError("banned column in model matrix")
    held = [c for c in features.columns if c not in K.PROVENANCE_COLUMNS]
    if held != names:
        raise ValueError("feature columns do not match the schema")
    return features.select(*names)


def write_features(df: DataFrame, path: str) -> DataFrame:
    """Write the table as zstd Parquet; returns its manifest row. Empty is an error."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    manifest = content_digest(df.sparkSession.read.parquet(path))
    if manifest.first()["row_count"] == 0:
        raise ValueError("empty feature set")
    return manifest


def verify(df: DataFrame, manifest: DataFrame, by=()) -> DataFrame:
    """Does the table, or each of its parts, still have the recorded counts and content?

    Parts on one side only are not intact.
    """
    by = list(by)
    now = content_digest(df, by)
    facts = [c for c in now.columns if c not in by]
    if not by:
        same = [F.col(c) == manifest.select(c).scalar() for c in facts]
        return now.select("row_count", (same[0] & same[1] & same[2]).alias("intact"))
    held = manifest.select(*by, *[F.col(c).alias(f"_{c}") for c in facts])
    same = F.lit(True)
    for c in facts:
        same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    return now.join(held, by, "full_outer").select(
        *by, F.coalesce("row_count", F.lit(0)).alias("row_count"), same.alias("intact"))
