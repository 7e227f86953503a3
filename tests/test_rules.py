import pytest
from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.operators import alerts as A, ledger, rules as R, signals as S

SCAN = R.RuleSpec("scan", "port_scan_v1", "reconnaissance", "medium", 60, 3)
FAIL = R.RuleSpec("fail", "repeated_failure_v1", "connection_failure", "low", 60, 3,
                  K.FAILURE_STATES)
RATE = R.RuleSpec("rate", "high_connection_rate_v1", "traffic_rate", "medium", 60, 3)


def test_port_scan_with_a_duplicate(make_flows):
    rows = [{"dst_port": p, "key": f"{p:064x}"} for p in (20, 21, 22, 22)]
    match = R.port_scan(make_flows(rows), SCAN).collect()
    assert [(m["observed_value"], m["evidence_count"]) for m in match] == [(3, 3)]
    assert R.port_scan(make_flows(rows[:2]), SCAN).count() == 0
    keys = R.evidence(make_flows(rows), SCAN, R.port_scan(make_flows(rows), SCAN))
    assert sorted(r["event_key"] for r in keys.collect()) == [f"{p:064x}" for p in (20, 21, 22)]


def test_failures_count_only_listed_zeek_states(make_flows):
    rows = [{"state": s} for s in ("REJ", "S0", "REJ", "UNKNOWN")]
    rows.append({"state": "REJ", "source_type": "normalized"})
    assert [m["observed_value"] for m in R.repeated_failure(make_flows(rows), FAIL).collect()] == [3]


def test_buckets_and_sensors_keep_groups_apart(make_flows):
    assert R.high_rate(make_flows([{"second": s} for s in (0, 59, 60)]), RATE).count() == 0
    mixed = [{"sensor_id": None}, {"sensor_id": None}, {"sensor_id": "a"}]
    assert R.high_rate(make_flows(mixed), RATE).count() == 0
    assert R.high_rate(make_flows([{"sensor_id": None}] * 3), RATE).first()["sensor_id"] is None


def test_exclusion_and_parameter_errors(spark, make_flows):
    assets = spark.createDataFrame([("a1", "192.0.2.1"), ("a2", None)],
                                   "asset_id string, address string")
    flows = make_flows([{}] * 4)
    assert R.exclude_assets(flows, assets, ["a1", "a2"]).count() == 0
    assert R.exclude_assets(flows, assets, ["a2"]).count() == 4
    with pytest.raises(ValueError):
        R.RuleSpec("x", "nope", "c", "low", 60, 3).check()
    with pytest.raises(ValueError):
        R.RuleSpec("x", "port_scan_v1", "c", "low", 60, 1).check()


def test_exclusion_holds_in_rule_sets_and_streams(spark, make_flows, tmp_path):
    """A rule that leaves assets out needs the table, in batches and in both streams."""
    from dataclasses import replace

    from flowguard.streaming import detect
    rule = replace(RATE, excluded_asset_ids=("a1",))
    assets = spark.createDataFrame([("a1", "192.0.2.1")], "asset_id string, address string")
    flows = make_flows([{}] * 4 + [{"src_address": "192.0.2.9"}] * 4)
    found = R.evaluate_rules(flows, [rule], assets).collect()
    assert [m["src_address"] for m in found] == ["192.0.2.9"]
    with pytest.raises(ValueError, match="no assets"):
        R.evaluate_rules(flows, [rule])
    with pytest.raises(ValueError, match="no assets"):
        detect.stream_rules(flows, [rule])
    flows.write.parquet(f"{tmp_path}/flows")
    live = spark.readStream.schema(flows.schema).parquet(f"{tmp_path}/flows")
    detect.start_detection(live, f"{tmp_path}/out", f"{tmp_path}/check", [rule],
                           assets).awaitTermination()
    assert detect.current_alerts(spark, f"{tmp_path}/out").count() == 1
    assert R.evaluate_rules(flows, [RATE]).count() == 2


def test_hot_source_gives_one_match(spark, make_flows):
    """A third of all rows in one group: partial sums, one match, whole evidence count."""
    flows = make_flows([{}]).drop("event_key").crossJoin(spark.range(30_000)) \
        .withColumn("event_key", F.sha2(F.col("id").cast("string"), 256)).drop("id")
    assert R.high_rate(flows, RATE).first()["evidence_count"] == 30_000


def test_signals_alerts_and_overflow(make_flows):
    flows = make_flows([{"key": f"{i:064x}"} for i in range(4)])
    early = S.with_signal_keys(R.high_rate(flows.limit(3), RATE))
    late = S.with_signal_keys(R.high_rate(flows, RATE))
    assert early.first()["series_key"] == late.first()["series_key"]
    new = S.novel_signals(late.unionByName(early), early)
    assert new.count() == 1
    alert = A.rollup_alerts(new, A.rollup_alerts(early)).collect()
    assert [a["occurrence_count"] for a in alert] == [2]
    kept, overflow = A.bounded_evidence(late.unionByName(early), 1)
    assert kept.count() == 1 and overflow.first()["overflow_count"] == 1
    _, none = A.bounded_evidence(late, 5)
    assert (none.first()["overflow_count"], none.first()["overflow_digest"]) == (0, None)


def test_ledger(make_flows):
    flows = make_flows([{"key": "a"}, {"key": "a"}, {"key": "b"}])
    assert ledger.new_events(flows, make_flows([{"key": "b"}])).count() == 1
    clash = flows.unionByName(make_flows([{"key": "b", "byte_count": 1}]))
    assert [r["event_key"] for r in ledger.conflicts(clash).collect()] == ["b"]
