"""Content hashes and order-free set digests."""

from pyspark.sql import Column, functions as F

LANES = 4
LANE_HEX = 12
LANE_PARTS = 3


def iso_z(ts: Column) -> Column:
    """UTC text with a Z suffix; the fraction is left out when it is zero."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def iso_offset(ts: Column) -> Column:
    """UTC text of a whole-second time with a +00:00 suffix."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def json_object(**fields: Column) -> Column:
    """A struct whose fields are in alphabetical order."""
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def canonical_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON object with sorted keys, no blanks and nulls kept."""
    return F.sha2(canonical_json(json_object(**fields)), 256)


def sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def event_key() -> Column:
    """Identity of a canonical flow: every contract field plus the sensor."""
    plain = [
        "schema_version", "source_type", "source_event_id", "src_address", "dst_address",
        "src_port", "dst_port", "protocol", "duration_ms", "packet_count", "byte_count",
        "state", "sensor_id",
    ]
    return canonical_hash(event_time=iso_z(F.col("event_time")),
                          metadata=sorted_map(F.col("metadata")),
                          **{name: F.col(name) for name in plain})


def signature_event_key() -> Column:
    """Identity of a signature event: every contract field plus the sensor."""
    plain = [
        "schema_version", "source_type", "source_event_id", "src_address", "dst_address",
        "src_port", "dst_port", "protocol", "signature_id", "signature_revision",
        "signature_name", "category", "reported_severity", "reported_action", "flow_id",
        "sensor_id",
    ]
    return canonical_hash(event_time=iso_z(F.col("event_time")),
                          **{name: F.col(name) for name in plain})


def lane_values(key: Column) -> list[Column]:
    """Four 48-bit numbers out of the key's hash; their sums identify a set of keys."""
    h = F.sha2(key, 256)
    return [
        F.conv(F.substring(h, 1 + LANE_HEX * i, LANE_HEX), 16, 10).cast("long")
        for i in range(LANES)
    ]


def lane_names(prefix: str = "_lane") -> list[str]:
    return [f"{prefix}{i}_{j}" for i in range(LANES) for j in range(LANE_PARTS)]


def parts_of(values: list[Column]) -> list[Column]:
    """Each lane in three 16-bit parts, whose sums stay whole numbers for 10^14 rows."""
    return [F.shiftright(v, 16 * j).bitwiseAND(F.lit(0xFFFF)) for v in values
            for j in range(LANE_PARTS)]


def lane_parts(key: Column) -> list[Column]:
    return parts_of(lane_values(key))


def lane_sums(key: Column, prefix: str = "_lane", values: list[Column] | None = None
              ) -> list[Column]:
    """Aggregates whose partial sums combine on the map side, whatever the order.

    ``values`` are the key's lanes where they have been computed before.
    """
    parts = parts_of(values) if values else lane_parts(key)
    return [F.sum(v).alias(n) for v, n in zip(parts, lane_names(prefix))]


def lane_totals(prefix: str = "_lane") -> list[Column]:
    """Second-level sums over columns made by :func:`lane_sums`."""
    return [F.sum(n).alias(n) for n in lane_names(prefix)]


def lanes_to_digest(count: Column, prefix: str = "_lane") -> Column:
    """Digest of a set from its size and its four lane sums."""
    parts = []
    for i in range(LANES):
        total = F.lit(0).cast("decimal(38,0)")
        for j in range(LANE_PARTS):
            part = F.coalesce(F.col(f"{prefix}{i}_{j}"), F.lit(0)).cast("decimal(19,0)")
            total = (total + part * F.lit(1 << (16 * j)).cast("decimal(11,0)")).cast(
                "decimal(38,0)")
        parts.append(total.cast("string"))
    return F.sha2(F.concat_ws("|", count.cast("string"), *parts), 256)
