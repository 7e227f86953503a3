"""What all text readers share: line checks, JSON access, and the outcome shape.

A reader turns every input line into one row with exactly one of ``flow``,
``signature`` and ``error_code`` set.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowguard import constants as K
from flowguard.functions.contracts import flow_ok, signature_ok
from flowguard.functions.network import canonical_ip

FLOW_TYPES = {
    "schema_version": "string", "source_type": "string", "source_event_id": "string",
    "event_time": "timestamp", "src_address": "string", "dst_address": "string",
    "src_port": "int", "dst_port": "int", "protocol": "string", "duration_ms": "bigint",
    "packet_count": "bigint", "byte_count": "bigint", "state": "string",
    "metadata": "map<string,string>",
}
SIGNATURE_TYPES = {
    "schema_version": "string", "source_type": "string", "source_event_id": "string",
    "event_time": "timestamp", "src_address": "string", "dst_address": "string",
    "src_port": "int", "dst_port": "int", "protocol": "string", "signature_id": "int",
    "signature_revision": "int", "signature_name": "string", "category": "string",
    "reported_severity": "int", "reported_action": "string", "flow_id": "string",
}


@dataclass(frozen=True)
class JsonField:
    """Text and type name of one JSON value; both null when it is not there."""

    text: Column
    kind: Column

    @property
    def is_text(self) -> Column:
        return F.coalesce(self.kind == "STRING", F.lit(False))

    @property
    def is_bool(self) -> Column:
        return F.coalesce(self.kind == "BOOLEAN", F.lit(False))

    @property
    def is_scalar(self) -> Column:
        return ~F.coalesce(self.kind.startswith("OBJECT") | self.kind.startswith("ARRAY"),
                           F.lit(False))


def with_fields(rows: DataFrame, paths) -> DataFrame:
    """Adds text and type of each JSON value as columns ``t.path`` and ``k.path``.

    Later steps read these columns, so each value is taken out of the document once.
    """
    out = []
    for path in paths:
        where = "$" + "".join(f'["{p}"]' for p in path)
        part = F.try_variant_get("doc", where, "variant")
        out += [F.try_variant_get("doc", where, "string").alias("t." + "/".join(path)),
                F.schema_of_variant(part).alias("k." + "/".join(path))]
    return rows.select("*", *out)


def with_top_fields(rows: DataFrame, keys) -> DataFrame:
    """As :func:`with_fields` for values at the top of the document, and ``keys`` with all its keys.

    One pass over the text gives all values and the set of keys.
    """
    held = rows.withColumn("_top", F.when(F.col("doc").isNotNull(), F.from_json(
        "value", "map<string,variant>")))
    values = [F.col("_top")[k] for k in keys]
    return held.select(
        *rows.columns, F.map_keys("_top").alias("keys"),
        *[v.cast("string").alias(f"t.{k}") for k, v in zip(keys, values)],
        *[F.schema_of_variant(v).alias(f"k.{k}") for k, v in zip(keys, values)])


def json_field(*path: str) -> JsonField:
    """A value taken out by :func:`with_fields`."""
    name = "/".join(path)
    return JsonField(F.col(f"`t.{name}`"), F.col(f"`k.{name}`"))


def text_lines(lines: DataFrame, skip_blank: bool) -> DataFrame:
    """Adds ``line_error``: too long, blank or not UTF-8. Input column: value."""
    raw = F.col("value")
    blank = ~raw.rlike(r"\S")
    error = (F.when(F.octet_length(raw) > K.MAX_LINE_BYTES, K.LINE_TOO_LONG)
             .when(~F.is_valid_utf8(raw), K.INVALID_RECORD))
    rows = lines.withColumn("line_error", error)
    if skip_blank:
        return rows.where(F.col("line_error").isNotNull() | (F.rtrim(F.regexp_replace(
            raw, r"\r+$", "")) != ""))
    return rows.withColumn("line_error", F.coalesce("line_error",
                                                    F.when(blank, K.EMPTY_RECORD)))


def parse_doc(rows: DataFrame) -> DataFrame:
    """Adds ``doc``: the JSON object of the line, null when it is none."""
    usable = F.when(F.col("line_error").isNull() & F.col("value").rlike(r"^\s*\{"),
                    F.col("value"))
    return rows.withColumn("doc", F.try_parse_json(usable))


def whole_in(value: Column, low: int, high: int) -> Column:
    """The number if it lies within the bounds, else null."""
    return F.when(value.between(low, high), value)


def finish(rows: DataFrame, flow: dict, flow_good: Column, signature: dict | None = None,
           signature_good: Column | None = None, is_signature: Column | None = None,
           keep=()) -> DataFrame:
    """Outcome rows: apply the contracts to the candidate columns.

    ``flow`` and ``signature`` map contract columns to expressions; ``*_good`` says
    whether every single value could be read.
    """
    sig_row = F.coalesce(is_signature, F.lit(False)) if is_signature is not None else F.lit(False)
    wide = rows.select(
        *keep, "line_error", sig_row.alias("_sig"),
        F.coalesce(flow_good, F.lit(False)).alias("_flow_good"),
        *([F.coalesce(signature_good, F.lit(False)).alias("_sig_good")] if signature else []),
        *[flow[c].cast(t).alias(f"f_{c}") for c, t in FLOW_TYPES.items()],
        *([signature[c].cast(t).alias(f"s_{c}") for c, t in SIGNATURE_TYPES.items()]
          if signature else []))

    def checked(prefix: str, types: dict, contract: Column) -> tuple[DataFrame, str]:
        nonlocal wide
        plain = wide.select("*", *[
            (canonical_ip(F.col(f"{prefix}_{c}")) if c.endswith("_address")
             else F.col(f"{prefix}_{c}")).alias(c) for c in types])
        name = f"_{prefix}_ok"
        wide = plain.withColumn(name, contract).withColumn(
            f"_{prefix}", F.struct(*types)).drop(*types)
        return name

    flow_name = checked("f", FLOW_TYPES, flow_ok())
    fine = F.col("line_error").isNull()
    flow_hit = fine & ~F.col("_sig") & F.col("_flow_good") & F.col(flow_name)
    if signature:
        sig_name = checked("s", SIGNATURE_TYPES, signature_ok())
        sig_hit = fine & F.col("_sig") & F.col("_sig_good") & F.col(sig_name)
        sig_value = F.when(sig_hit, F.col("_s"))
    else:
        sig_hit = F.lit(False)
        sig_value = F.lit(None).cast(
            "struct<" + ",".join(f"{c}:{t}" for c, t in SIGNATURE_TYPES.items()) + ">")
    error = F.when(~flow_hit & ~sig_hit, F.coalesce("line_error", F.lit(K.INVALID_RECORD)))
    # One outcome per line, as a generated row: filters on outcomes stay above it and do
    # not repeat the parsing expressions below.
    outcome = F.struct(F.when(flow_hit, F.col("_f")).alias("flow"), sig_value.alias("signature"),
                       error.alias("error_code"))
    return wide.select(*keep, F.explode(F.array(outcome)).alias("o")).select(
        *keep, "o.flow", "o.signature", "o.error_code")
