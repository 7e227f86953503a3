"""Readers: canonical JSON lines, Zeek connection logs, EVE JSON, decoded packets."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowguard import constants as K
from flowguard.functions.network import canonical_ip
from flowguard.functions.parsing import half_even, parse_ts, to_float, to_int
from flowguard.sources.lines import (finish, json_field, parse_doc, text_lines, whole_in,
                                     with_fields, with_top_fields)

NORMALIZED_KEYS = ("schema_version", "source_event_id", "event_time", "src_address",
                   "dst_address", "src_port", "dst_port", "protocol", "duration_ms",
                   "packet_count", "byte_count", "state")
EMPTY_MAP = "map<string,string>"


def text_source(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw lines with the file they come from and, unless streamed, their order in it.

    ``line_at`` is the block of the file and a number that rises within the block.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").option("lineSep", "\n").load(path)
    origin = F.col("_metadata.file_path").alias("input_file")
    if stream:
        return lines.select("value", origin)
    return lines.select("value", origin, F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")).alias("line_at"))


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _no_metadata() -> Column:
    return F.create_map().cast(EMPTY_MAP)


def _one_entry(key: str, value: Column) -> Column:
    held = value.isNotNull() & ~value.isin("-", "")
    return F.when(held, F.create_map(F.lit(key), value)).otherwise(_no_metadata())


def parse_flow_lines(lines: DataFrame) -> DataFrame:
    """Canonical JSON lines: twelve known keys, everything else is a reject."""
    rows = with_top_fields(parse_doc(text_lines(lines, skip_blank=False)), NORMALIZED_KEYS)
    f = {k: json_field(k) for k in NORMALIZED_KEYS}
    whole = ("src_port", "dst_port", "duration_ms", "packet_count", "byte_count")
    rows = rows.select("*", parse_ts(f["event_time"].text).alias("at"), *[
        to_int(f[n].text, f[n].is_text, None).alias(f"n.{n}") for n in whole])
    known = F.size(F.array_except("keys", F.array(*[F.lit(k) for k in NORMALIZED_KEYS]))) == 0

    def number(name: str) -> tuple[Column, Column]:
        got = F.col(f"`n.{name}`")
        there = f[name].text.isNotNull() & ~f[name].text.isin("-", "")
        return got["value"], got["ok"] & there & ~f[name].is_bool

    def optional(name: str) -> tuple[Column, Column]:
        value, ok = number(name)
        return value, ok | f[name].text.isNull()

    texts = [f[n].is_text for n in ("schema_version", "src_address", "dst_address", "protocol")]
    texts += [f[n].text.isNull() | f[n].is_text for n in ("source_event_id", "state")]
    counters = {n: number(n) for n in ("duration_ms", "packet_count", "byte_count")}
    ports = {n: optional(n) for n in ("src_port", "dst_port")}
    bounded = [v.isNull() | v.between(0, K.MAX_PORT) for v, _ in ports.values()]
    good = known & F.col("doc").isNotNull() & ~f["event_time"].is_bool
    for c in texts + bounded + [ok for _, ok in (*counters.values(), *ports.values())]:
        good = good & c
    flow = {
        "schema_version": f["schema_version"].text, "source_type": F.lit("normalized"),
        "source_event_id": f["source_event_id"].text,
        "event_time": F.col("at"),
        "src_address": f["src_address"].text, "dst_address": f["dst_address"].text,
        **{n: whole_in(v, 0, K.MAX_PORT) for n, (v, _) in ports.items()},
        "protocol": F.lower(f["protocol"].text), **{n: v for n, (v, _) in counters.items()},
        "state": f["state"].text, "metadata": _no_metadata(),
    }
    return finish(rows, flow, good, keep=["input_file"])


def read_flows_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_flow_lines(text_source(spark, path))


ZEEK_FIELDS = ("uid", "ts", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto",
               "duration", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes", "conn_state",
               "service")


def zeek_headers(lines: DataFrame) -> DataFrame:
    """One row per file with its headers in order, each with its place and field names.

    Lines without an order (no ``line_at``) need one header for the whole file; files with
    different ones have none.
    """
    marks = lines.where(F.col("value").startswith("#fields"))
    fields = F.slice(F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t"), 2, 1_000_000)
    ordered = "line_at" in lines.columns
    place = F.col("line_at") if ordered else F.lit(None).cast("struct<block:bigint,row:bigint>")
    headers = (marks.select(F.col("input_file").alias("_file"),
                            F.struct(place.alias("at"), fields.alias("fields")).alias("h"))
               .groupBy("_file").agg(F.array_sort(F.collect_set("h")).alias("headers")))
    return headers if ordered else headers.where(F.size("headers") == 1)


def parse_zeek_lines(lines: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Zeek connection records, tab-separated under a #fields header or as JSON lines."""
    headers = zeek_headers(lines) if headers is None else headers
    data = text_lines(lines.where(~F.col("value").startswith("#")), skip_blank=True)
    # A record is read by the last header before it.
    above = F.col("headers")
    if "line_at" in lines.columns:
        above = F.filter(above, lambda h: h["at"].isNull() | (h["at"] < F.col("line_at")))
    data = (data.join(headers, F.col("input_file") == F.col("_file"), "left")
            .withColumn("fields", F.try_element_at(above, F.lit(-1))["fields"]))
    rows = parse_doc(data)
    rows = with_fields(rows, [(n,) for n in ZEEK_FIELDS]).select(
        "*", F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t").alias("_parts"),
        F.col("value").startswith("{").alias("is_json"))
    is_json = F.col("is_json")
    rows = rows.select("*", F.coalesce(F.size("_parts") == F.size("fields"), F.lit(False))
                       .alias("fits"))
    scalar = F.lit(True)
    for name in ZEEK_FIELDS:
        j = json_field(name)
        scalar = scalar & (~is_json | (j.is_scalar & ~j.is_bool))
        at = F.array_position("fields", name).cast("int")
        cell = F.when(F.col("fits") & (at > 0), F.try_element_at("_parts", F.when(at > 0, at)))
        rows = rows.withColumn(f"z.{name}", F.when(is_json, j.text).otherwise(cell))
    text = {n: F.col(f"`z.{n}`") for n in ZEEK_FIELDS}
    whole = ("id.orig_p", "id.resp_p", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes")
    rows = rows.select("*", to_float(text["duration"]).alias("span"),
                       parse_ts(text["ts"]).alias("at"), *[
        to_int(text[n], ~is_json | json_field(n).is_text).alias(f"n.{n}") for n in whole])
    ints = {n: F.col(f"`n.{n}`") for n in whole}
    span = F.col("span")
    good = (F.when(is_json, F.col("doc").isNotNull()).otherwise(F.col("fits")) & scalar
            & span["ok"] & text["uid"].isNotNull() & text["proto"].isNotNull())
    for c in ints.values():
        good = good & c["ok"]
    for n in ("id.orig_p", "id.resp_p"):
        good = good & ints[n]["value"].between(0, K.MAX_PORT)
    state = text["conn_state"]
    flow = {
        "schema_version": F.lit(K.FLOW_SCHEMA_VERSION), "source_type": F.lit("zeek"),
        "source_event_id": text["uid"], "event_time": F.col("at"),
        "src_address": text["id.orig_h"], "dst_address": text["id.resp_h"],
        "src_port": whole_in(ints["id.orig_p"]["value"], 0, K.MAX_PORT),
        "dst_port": whole_in(ints["id.resp_p"]["value"], 0, K.MAX_PORT),
        "protocol": F.lower(text["proto"]),
        "duration_ms": half_even(F.greatest(F.lit(0.0), F.least(
            F.lit(1e15), span["value"] * 1000))),
        "packet_count": F.try_add(ints["orig_pkts"]["value"], ints["resp_pkts"]["value"]),
        "byte_count": F.try_add(ints["orig_bytes"]["value"], ints["resp_bytes"]["value"]),
        "state": F.when(state != "-", state),
        "metadata": _one_entry("service", text["service"]),
    }
    return finish(rows, flow, good, keep=["input_file"])


def read_zeek(spark: SparkSession, path: str) -> DataFrame:
    return parse_zeek_lines(text_source(spark, path))


def parse_eve_lines(lines: DataFrame) -> DataFrame:
    """EVE JSON: ``flow`` records become flows, ``alert`` records signature events."""
    top_names = ("event_type", "timestamp", "flow_id", "src_ip", "dest_ip", "src_port",
                 "dest_port", "proto", "app_proto", "flow", "alert")
    inner_names = ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "start",
                   "end", "state")
    alert_names = ("action", "signature_id", "rev", "signature", "category", "severity")
    rows = with_fields(
        parse_doc(text_lines(lines, skip_blank=False)),
        [(n,) for n in top_names] + [("flow", n) for n in inner_names]
        + [("alert", n) for n in alert_names])
    doc = F.col("doc")
    top = {n: json_field(n) for n in top_names}
    inner = {n: json_field("flow", n) for n in inner_names}
    alert = {n: json_field("alert", n) for n in alert_names}
    whole = {**{n: top[n] for n in ("src_port", "dest_port")},
             **{n: inner[n] for n in inner_names[:4]},
             **{n: alert[n] for n in ("signature_id", "rev", "severity")}}
    at_text = top["timestamp"].text
    rows = rows.select(
        "*", parse_ts(at_text).alias("at"), parse_ts(F.when(
            inner["start"].kind.isNull(), at_text).otherwise(inner["start"].text)).alias("start"),
        parse_ts(F.when(inner["end"].kind.isNull(), at_text).otherwise(inner["end"].text))
        .alias("end"),
        *[to_int(field.text, field.is_text).alias(f"n.{n}") for n, field in whole.items()])
    num = {n: F.col(f"`n.{n}`") for n in whole}
    ports = {n: num[n] for n in ("src_port", "dest_port")}
    counters = {n: num[n] for n in inner_names[:4]}
    numbers = {n: num[n] for n in ("signature_id", "rev", "severity")}
    at, start, end = F.col("at"), F.col("start"), F.col("end")
    is_alert = F.coalesce(top["event_type"].text == "alert", F.lit(False))
    shared = doc.isNotNull() & top["proto"].text.isNotNull() & ~top["timestamp"].is_bool
    for n in ports:
        shared = shared & ports[n]["ok"] & ~top[n].is_bool \
            & ports[n]["value"].between(0, K.MAX_PORT)
    flow_good = (shared & (top["event_type"].text == "flow")
                 & top["flow"].kind.startswith("OBJECT") & top["flow_id"].text.isNotNull()
                 & start.isNotNull() & end.isNotNull())
    for n in counters:
        flow_good = flow_good & counters[n]["ok"] & ~inner[n].is_bool
    sig_good = shared & top["alert"].kind.startswith("OBJECT")
    for n in numbers:
        sig_good = sig_good & alert[n].kind.isNotNull() & numbers[n]["ok"] & ~alert[n].is_bool \
            & numbers[n]["value"].between(0, K.MAX_INT32)
    sig_good = sig_good & alert["signature"].text.isNotNull() & alert["category"].text.isNotNull()
    span = F.greatest(F.lit(0), F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)
    app = top["app_proto"].text
    common = {
        "source_event_id": top["flow_id"].text, "event_time": at,
        "src_address": top["src_ip"].text, "dst_address": top["dest_ip"].text,
        "src_port": whole_in(ports["src_port"]["value"], 0, K.MAX_PORT),
        "dst_port": whole_in(ports["dest_port"]["value"], 0, K.MAX_PORT),
        "protocol": F.lower(top["proto"].text),
    }
    flow = {
        **common, "schema_version": F.lit(K.FLOW_SCHEMA_VERSION),
        "source_type": F.lit("suricata"), "duration_ms": half_even(span),
        "packet_count": F.try_add(counters["pkts_toserver"]["value"],
                                  counters["pkts_toclient"]["value"]),
        "byte_count": F.try_add(counters["bytes_toserver"]["value"],
                                counters["bytes_toclient"]["value"]),
        "state": F.nullif(inner["state"].text, F.lit("")),
        "metadata": F.when(F.length(app) > 0, F.create_map(F.lit("app_proto"), app))
        .otherwise(_no_metadata()),
    }
    signature = {
        **common, "schema_version": F.lit(K.SIGNATURE_SCHEMA_VERSION),
        "source_type": F.lit("suricata"),
        "signature_id": whole_in(numbers["signature_id"]["value"], 0, K.MAX_INT32),
        "signature_revision": whole_in(numbers["rev"]["value"], 0, K.MAX_INT32),
        "signature_name": alert["signature"].text, "category": alert["category"].text,
        "reported_severity": whole_in(numbers["severity"]["value"], 0, K.MAX_INT32),
        "reported_action": F.nullif(alert["action"].text, F.lit("")),
        "flow_id": top["flow_id"].text,
    }
    return finish(rows, flow, flow_good, signature, sig_good, is_alert, keep=["input_file"])


def read_eve(spark: SparkSession, path: str) -> DataFrame:
    return parse_eve_lines(text_source(spark, path))


def packet_ok() -> Column:
    """A packet counts when its time is finite and both hosts are addresses."""
    finite = F.abs(F.col("ts")) < F.lit(253402300800.0)
    return F.coalesce(finite & canonical_ip(F.col("src")).isNotNull()
                      & canonical_ip(F.col("dst")).isNotNull(), F.lit(False))


def packets_to_flows(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flows, rejects) out of decoded packets: ts, src, dst, sport, dport, proto, length.

    One flow per directed 5-tuple; the sums are partial on the map side, so a tuple
    with most packets is no burden. ICMP and other protocols have no ports.
    """
    rows = packets.withColumn("_ok", packet_ok())
    kind = F.when(F.col("proto").isin("tcp", "udp", "icmp"), F.col("proto")) \
        .when(F.col("proto") == "icmpv6", "icmp").otherwise("other")
    ported = kind.isin("tcp", "udp")
    flows = (rows.where("_ok").groupBy(
        canonical_ip(F.col("src")).alias("src_address"),
        canonical_ip(F.col("dst")).alias("dst_address"),
        F.when(ported, F.col("sport")).cast("int").alias("src_port"),
        F.when(ported, F.col("dport")).cast("int").alias("dst_port"), kind.alias("protocol"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"),
             F.count(F.lit(1)).alias("packet_count"),
             F.sum("length").cast("bigint").alias("byte_count"))
        .select(F.lit(K.FLOW_SCHEMA_VERSION).alias("schema_version"),
                F.lit("pcap").alias("source_type"), _none().alias("source_event_id"),
                F.timestamp_micros(half_even(F.col("first") * 1_000_000)).alias("event_time"),
                "src_address", "dst_address", "src_port", "dst_port", "protocol",
                F.greatest(F.lit(0), half_even((F.col("last") - F.col("first")) * 1000))
                .alias("duration_ms"), "packet_count", "byte_count", _none().alias("state"),
                _no_metadata().alias("metadata")))
    rejects = rows.where("NOT _ok").select(F.lit(K.UNSUPPORTED_PACKET).alias("error_code"))
    return flows, rejects
