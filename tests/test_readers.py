import json
import random

from flowguard.sources import outcomes, readers, sinks

GOOD = {"schema_version": "1", "source_event_id": "e1", "event_time": "2024-01-01T00:00:00Z",
        "src_address": "192.0.2.1", "dst_address": "2001:0db8:0::0001", "src_port": 1, "dst_port": 2,
        "protocol": "TCP", "duration_ms": 5, "packet_count": 2, "byte_count": 4096, "state": "SF"}


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_bytes(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines) + b"\n")
    return str(path)


def codes(df):
    return sorted(r["error_code"] or "ok" for r in df.select("error_code").collect())


def test_canonical_lines(spark, tmp_path):
    bad = [{**GOOD, "label": 1}, {**GOOD, "event_time": "2024-01-01T00:00:00"},
           {**GOOD, "src_address": "999.1.1.1"}, {**GOOD, "state": "S 0"},
           {**GOOD, "src_port": None}, {**GOOD, "duration_ms": 604_800_001},
           {**GOOD, "protocol": 6}, {**GOOD, "byte_count": 1.5}, {**GOOD, "schema_version": "2"}]
    lines = [json.dumps(GOOD), json.dumps(GOOD)[:30], "", "[]", b"\xff\xfe{", "x" * 65_537,
             *[json.dumps(b) for b in bad], json.dumps(GOOD).replace("4096", "1e309")]
    df = readers.read_flows_jsonl(spark, write(tmp_path, "a.jsonl", lines))
    assert codes(df).count("ok") == 1 and codes(df).count("empty_record") == 1
    assert codes(df).count("line_too_long") == 1
    assert codes(df).count("invalid_record") == len(lines) - 3
    flow = df.where("flow IS NOT NULL").first()["flow"]
    assert (flow["byte_count"], flow["protocol"], flow["dst_address"]) == (4096, "tcp",
                                                                         "2001:db8::1")


def test_zeek_lines_and_headers(spark, tmp_path):
    names = ("ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes "
             "resp_bytes conn_state orig_pkts resp_pkts").split()
    row = ["1704067200.25", "C1", "192.0.2.1", "1234", "198.51.100.2", "80", "tcp", "http", "0.5",
           "1600", "2000", "SF", "6", "7"]
    lines = ["#separator \\x09", "#fields\t" + "\t".join(names), "\t".join(row),
             "\t".join(row[:-1]), "\t".join(["bad", *row[1:]]),
             json.dumps({**dict(zip(names, row)), "uid": "C2", "conn_state": "-",
                         "id.orig_p": None}), "#close"]
    df = readers.read_zeek(spark, write(tmp_path, "conn.log", lines))
    assert codes(df) == ["invalid_record", "invalid_record", "ok", "ok"]
    flows = {r["flow"]["source_event_id"]: r["flow"] for r in df.where("flow IS NOT NULL").collect()}
    one, two = flows["C1"], flows["C2"]
    assert (one["packet_count"], one["byte_count"], one["duration_ms"]) == (13, 3600, 500)
    assert one["metadata"] == {"service": "http"} and one["event_time"].microsecond == 250_000
    assert two["state"] is None and two["src_port"] == 0


def test_records_follow_the_last_header_before_them(spark, tmp_path):
    names = ("ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes "
             "resp_bytes conn_state orig_pkts resp_pkts").split()
    row = ["1704067200", "C", "192.0.2.1", "1234", "198.51.100.2", "80", "tcp", "http", "0.5",
           "1600", "2000", "SF", "6", "7"]

    def record(order, uid):
        held = {**dict(zip(names, row)), "uid": uid}
        return "\t".join(held[n] for n in order)
    lines = [record(names, "early")]
    for k in range(6):
        order = names[k:] + names[:k]
        lines += ["#fields\t" + "\t".join(order)]
        lines += [record(order, f"C{k}_{i}") for i in range(40)]
    path = write(tmp_path, "c.log", lines)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.read_zeek(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r["error_code"] for r in got if r["error_code"]] == ["invalid_record"]
    ids = {r["flow"]["source_event_id"] for r in got if r["flow"]}
    assert ids == {f"C{k}_{i}" for k in range(6) for i in range(40)}
    assert {r["flow"]["src_port"] for r in got if r["flow"]} == {1234}


def test_eve_lines(spark, tmp_path):
    common = {"timestamp": "2024-01-01T00:00:01.500000+0000", "flow_id": 7, "src_ip": "192.0.2.1",
              "dest_ip": "198.51.100.1", "src_port": 1, "dest_port": 2, "proto": "TCP"}
    flow = {**common, "event_type": "flow", "app_proto": "http", "flow": {
        "pkts_toserver": 3, "pkts_toclient": 4, "bytes_toserver": 5, "bytes_toclient": 6,
        "start": "2024-01-01T00:00:00+00:00", "end": "2024-01-01T00:00:01.5+00:00",
        "state": "established"}}
    alert = {**common, "event_type": "alert", "alert": {
        "action": "allowed", "signature_id": 2100001, "rev": 3, "signature": "seen",
        "category": "policy", "severity": 2}}
    broken = [{**alert, "alert": {**alert["alert"], "signature": "a\u0000b"}},
              {**alert, "alert": {**alert["alert"], "severity": 999}},
              {**alert, "alert": {"signature_id": 0}}, {**flow, "dest_ip": "nope"},
              {**common, "event_type": "dns"}]
    df = readers.read_eve(spark, write(tmp_path, "eve.json",
                                       [json.dumps(x) for x in [flow, alert, *broken]]))
    assert codes(df).count("invalid_record") == len(broken)
    got = df.where("flow IS NOT NULL").first()["flow"]
    assert (got["packet_count"], got["byte_count"], got["duration_ms"]) == (7, 11, 1500)
    assert df.where("signature IS NOT NULL").first()["signature"]["signature_id"] == 2100001
    flows, signatures, rejects = outcomes.split_outcomes(df)
    assert (flows.count(), signatures.count(), rejects.count()) == (1, 1, len(broken))
    assert len(flows.first()["event_key"]) == 64


def test_random_bytes_never_fail(spark, tmp_path):
    rng = random.Random(5)
    lines = [bytes(b for b in rng.randbytes(rng.randint(1, 256)) if b != 10) for _ in range(200)]
    path = write(tmp_path, "noise", lines)
    for read in (readers.read_flows_jsonl, readers.read_zeek, readers.read_eve):
        assert "ok" not in codes(read(spark, path))


def test_packets(spark):
    rows = [(10.0, "192.0.2.1", "192.0.2.2", 1, 2, "tcp", 100),
            (10.5, "192.0.2.1", "192.0.2.2", 1, 2, "tcp", 50),
            (10.0, "192.0.2.1", "192.0.2.2", 1, 2, "icmp", 9),
            (float("nan"), "192.0.2.1", "192.0.2.2", 1, 2, "tcp", 9),
            (10.0, None, "192.0.2.2", 1, 2, "tcp", 9)]
    df = spark.createDataFrame(rows, "ts double, src string, dst string, sport int, dport int, "
                                     "proto string, length long")
    flows, rejects = readers.packets_to_flows(df)
    got = {r["protocol"]: r for r in flows.collect()}
    assert (got["tcp"]["packet_count"], got["tcp"]["duration_ms"], got["tcp"]["byte_count"]) == (
        2, 500, 150)
    assert got["icmp"]["src_port"] is None and rejects.count() == 2


def test_written_lines_are_read_back(spark, tmp_path, make_flows):
    flows = make_flows([{"second": 1, "source_type": "normalized", "source_event_id": "a"},
                        {"second": 2, "source_type": "normalized", "state": None}])
    path = str(tmp_path / "out")
    from pyspark.sql import functions as F
    lines = sinks.flow_lines(flows).select(F.to_json(F.map_filter(
        F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin("metadata",
                                                                        "source_type")))
        .alias("value"))
    lines.write.text(path)
    assert codes(readers.read_flows_jsonl(spark, path)) == ["ok", "ok"]
