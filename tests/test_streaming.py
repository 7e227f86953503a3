import json

import pytest
from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.operators import alerts as A, rules as R, signals as S
from flowguard.operators.windows import window_features
from flowguard.streaming import detect, features, ingest
from flowguard.streaming.ledger import DatedTable, Ledger, key_filter, may_hold

RULES = [R.RuleSpec("scan", "port_scan_v1", "reconnaissance", "medium", 60, 3),
         R.RuleSpec("rate", "high_connection_rate_v1", "traffic_rate", "medium", 60, 3)]


def put(df, folder, name):
    """One more file for a stream to find."""
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def test_ingest_batches_and_repeats(spark, tmp_path):
    good = {"schema_version": "1", "event_time": "2024-01-01T00:00:00Z", "src_address": "192.0.2.1",
            "dst_address": "192.0.2.2", "src_port": 1, "dst_port": 2, "protocol": "tcp",
            "duration_ms": 5, "packet_count": 2, "byte_count": 3}
    line = lambda i: json.dumps({**good, "source_event_id": str(i)})
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for name, lines in (("a", [line(1), line(1), "{}"]), ("b", [line(1), line(2), ""])):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        ingest.start_ingest(spark, str(tmp_path / "in"), "normalized", out, check, "job") \
            .awaitTermination()
    flows = Ledger(spark, f"{out}/flows").read()
    assert sorted(r["source_event_id"] for r in flows.collect()) == ["1", "2"]
    assert ingest.read_batches(spark, f"{out}/rejects").count() == 2


def test_late_events_change_the_alert(spark, tmp_path, make_flows):
    first = make_flows([{"second": s, "dst_port": s} for s in (0, 1, 2)])
    second = make_flows([{"second": 500, "key": "f" * 64}, {"second": 3, "dst_port": 9,
                                                            "key": "e" * 64}])
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for name, df in (("a", first), ("b", second)):
        put(df, src, name)
        detect.start_detection(stream(spark, src, first.schema), out, check, RULES) \
            .awaitTermination()
    # the same batch once more leaves everything as it is
    detect.upsert_batch(second, 1, out, RULES)
    alerts = {r["category"]: r for r in detect.current_alerts(spark, out).collect()}
    assert alerts["reconnaissance"]["occurrence_count"] == 2
    assert alerts["traffic_rate"]["occurrence_count"] == 2
    whole = S.with_signal_keys(R.evaluate_rules(first.unionByName(second), RULES))
    known = {r["semantic_key"] for r in DatedTable(spark, f"{out}/signals", "bucket_start").read().collect()}
    assert {r["semantic_key"] for r in whole.collect()} <= known
    schema = spark.read.parquet(f"{out}/alert_changes/*").schema
    detect.start_feed(detect.alert_feed(spark, out, schema), str(tmp_path / "feed"),
                      str(tmp_path / "feed-check")).awaitTermination()
    feed = spark.read.json(str(tmp_path / "feed"))
    assert {(r["batch"], r["sequence"]) for r in feed.collect()} == {(0, 1), (1, 2)}


def test_append_rules_after_dedup(spark, tmp_path, make_flows):
    rows = [{"second": s, "dst_port": s} for s in (0, 1, 2)] + [{"second": 600, "key": "f" * 64}]
    flows = make_flows(rows)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    put(flows.unionByName(flows), src, "a")
    once = ingest.stream_dedup(stream(spark, src, flows.schema), "10 seconds")
    (detect.stream_rules(once, RULES).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
     .awaitTermination())
    got = {r["rule_key"]: r for r in spark.read.parquet(out).collect()}
    batch = {r["rule_key"]: r for r in R.evaluate_rules(flows, RULES).collect()}
    assert set(got) == {"scan", "rate"}
    assert all(got[k]["evidence_digest"] == batch[k]["evidence_digest"] for k in got)


def test_stream_features_equal_batch(spark, tmp_path, make_flows):
    import random
    rng = random.Random(4)
    rows = [dict(second=rng.randint(0, 900), key=f"{rng.getrandbits(200):064x}",
                 dst_port=rng.choice([None, 1, 2]), dst_address=rng.choice(["a", "b"]),
                 sensor_id=rng.choice([None, "s"]), duration_ms=rng.randint(0, 99),
                 state=rng.choice(["REJ", "SF"])) for _ in range(150)]
    flows = make_flows(rows)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    check = str(tmp_path / "check")
    end = make_flows([{"second": 5000, "key": "f" * 64, "src_address": "192.0.2.99"}])
    cut = F.timestamp_seconds(F.lit(1704067200 + 450))
    for name, df in (("a", flows.where(F.col("event_time") <= cut)),
                     ("b", flows.where(F.col("event_time") > cut)), ("c", end)):
        put(df, src, name)
        (features.stream_features(stream(spark, src, flows.schema), delay="1 second").writeStream
         .format("parquet").option("path", out).option("checkpointLocation", check)
         .trigger(availableNow=True).start().awaitTermination())
    got = {r["event_key"]: r for r in spark.read.parquet(out).collect()}
    want = {r["event_key"]: r for r in window_features(flows).collect()}
    assert set(want) == set(got)
    for key, row in want.items():
        for w in (60, 300):
            for n in K.WINDOW_FEATURES:
                assert got[key][f"w{w}_{n}"] == pytest.approx(row[f"w{w}_{n}"]), (key, n)


def test_filter_rules_out_only_new_keys(spark):
    import datetime
    rows = spark.createDataFrame([(f"k{i}", datetime.date(2024, 1, 1 + i % 2)) for i in range(2000)],
                                 "event_key string, event_date date")
    held = rows.where("substring(event_key, 2) < 1000")
    got = may_hold(rows, key_filter(held, ["event_key"], 4), ["event_key"], 4)
    keys = {r[0] for r in held.collect()}
    seen = {r["event_key"] for r in got.where("_seen").collect()}
    assert keys <= seen and len(seen - keys) < 20
    other = held.where("event_date = '2024-01-01'")
    late = may_hold(rows.where("event_date = '2024-01-02'"), key_filter(other, ["event_key"], 4), ["event_key"], 4)
    assert late.where("_seen").count() == 0


def test_ledger_reads_its_dates_and_compacts(spark, tmp_path, make_flows):
    day = 86_400
    batches = [make_flows([{"second": s, "key": f"{s:064x}"} for s in seconds]) for seconds in
               ((0, 1, day), (1, 2, 2 * day, 0), (day, day + 1, 3), (3,))]
    table = Ledger(spark, str(tmp_path / "t"), blocks=2)
    new = [table.add(b, i) for i, b in enumerate(batches)]
    assert [0 if n is None else n.count() for n in new] == [3, 2, 2, 0]
    assert table.dates() == ["2024-01-01", "2024-01-02", "2024-01-03"]
    first = table.read(["2024-01-01"], before=2)
    assert first.count() == 3 and all("2024-01-01" in f for f in first.inputFiles())
    want = sorted(r["event_key"] for r in table.read().collect())
    table.compact(table.dates(), 1)
    assert sorted(table._parts("2024-01-01")) == [-2, 2]
    assert sorted(r["event_key"] for r in table.read().collect()) == want
    again = table.add(batches[2], 2)
    assert again.count() == 2 and sorted(r["event_key"] for r in table.read().collect()) == want
    assert table.add(batches[0], 5) is None


def test_late_rows_are_settled(spark, tmp_path, make_flows):
    """Two batches, the second partly late: rules and features end up as over the whole table."""
    import random
    g = random.Random(8)
    rows = [dict(second=g.randint(0, 400), key=f"{g.getrandbits(200):064x}", dst_port=g.randint(1, 5),
                 src_address=g.choice(["192.0.2.1", "192.0.2.2"])) for _ in range(120)]
    first, second = make_flows(rows[:60]), make_flows(rows[60:] + [dict(second=2000, key="f" * 64)])
    flows = first.unionByName(second)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for name, df in (("a", first), ("b", second)):
        put(df, src, name)
        ingest.start_divert(stream(spark, src, first.schema), out, str(tmp_path / "check"), 30) \
            .awaitTermination()
    assert DatedTable(spark, f"{out}/late").read().count() > 20
    stored = Ledger(spark, f"{out}/flows").read().drop("event_date", "batch_id")
    live = lambda: ingest.on_time_flows(spark, out, stored.schema)
    for name, made in (("rules", detect.stream_rules(live().withWatermark("event_time", "30 seconds"), RULES)),
                       ("features", features.stream_features(live(), delay="30 seconds"))):
        (made.writeStream.format("parquet").option("path", f"{out}/{name}")
         .option("checkpointLocation", f"{out}/{name}-check").trigger(availableNow=True).start()
         .awaitTermination())
    columns = ["rule_key", "bucket_start", "src_address", "dst_address", "observed_value", "evidence_digest"]
    got = detect.settled_rules(spark, out, spark.read.parquet(f"{out}/rules"), RULES, 30)
    want = R.evaluate_rules(flows, RULES)
    text = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert text(got) == text(want)
    got = features.settled_features(stored, spark.read.parquet(f"{out}/features"))
    want = window_features(flows).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_live_path_with_signature_events(spark, tmp_path):
    alert = {"timestamp": "2024-01-01T00:00:0%d.000000+0000", "event_type": "alert", "src_ip": "192.0.2.1",
             "dest_ip": "192.0.2.2", "src_port": 1, "dest_port": 2, "proto": "TCP", "flow_id": 7,
             "alert": {"action": "allowed", "gid": 1, "signature_id": 5, "rev": 1, "signature": "x",
                       "category": "c", "severity": 2}}
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for i in range(2):
        line = json.dumps({**alert, "timestamp": alert["timestamp"] % i})
        (tmp_path / "in" / f"{i}.json").write_text(line + "\n")
        detect.start_live(spark, str(tmp_path / "in"), "suricata", out, str(tmp_path / "check"), "job", RULES) \
            .awaitTermination()
    signals = DatedTable(spark, f"{out}/signals", "bucket_start").read()
    assert {r["source_type"] for r in signals.collect()} == {"suricata_signature"}
    assert detect.current_alerts(spark, out).agg(F.sum("occurrence_count")).first()[0] == signals.count() == 2


class _Map(dict):
    """A map state within the test's own process."""

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class _Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return _Map()

    def registerTimer(self, at):
        self.timers.append(at)


class _Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_slice_of_stream_features_is_emptied_at_its_end():
    import pandas as pd
    handle, op = _Handle(), features.WindowFeatures((60, 300))
    op.init(handle)
    key = ("s", "192.0.2.1", 1)
    rows = [(t * 1_000_000, f"k{t}", "a", 80, "tcp", 1, 1, 1, 0, t >= 1200)
            for t in (1000, 1190, 1210, 2390)]
    list(op.handleInputRows(key, iter([pd.DataFrame(rows, columns=features.ROW)]), _Mark(0)))
    out = pd.concat(list(op.handleExpiredTimer(key, _Mark(2_395_000), None)))
    assert list(out["event_key"]) == ["k1210", "k2390"]
    assert list(out["w300_flow_count"]) == [3, 1] and len(op.recent) == 1
    assert handle.timers[-1] == 2_400_001
    list(op.handleExpiredTimer(key, _Mark(2_400_001), None))
    assert not op.recent and not op.waiting


def test_ingested_lines_are_stored_compressed(spark, tmp_path):
    import datetime
    import glob
    from flowguard.session import shared_dir
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, at, i, "view", 1.5, '{"k": 3}') for i in range(20)],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                          "value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    from flowguard.plans import q_streams
    assert q_streams.str_1(spark, str(tmp_path)).count() == 20
    held = glob.glob(f"{shared_dir(spark)}/flowguard-ingest-*/input/part-*")
    assert held and all(f.endswith(".gz") for f in held)
