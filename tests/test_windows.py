import random

import pytest

from flowguard import constants as K
from flowguard.operators import features as FT
from flowguard.operators.windows import busy_sources, window_features

FAIL = set(K.FAILURE_STATES)


def brute(rows, w):
    out = {}
    for t in rows:
        near = [r for r in rows if r["sensor_id"] == t["sensor_id"]
                and r["src_address"] == t["src_address"] and r["second"] >= t["second"] - w
                and (r["second"], r["key"]) <= (t["second"], t["key"])]
        same = [r["second"] for r in near if r["key"] != t["key"] and all(
            r[c] == t[c] for c in ("dst_address", "dst_port", "protocol"))]
        n = len(near)
        out[t["key"]] = (
            n, len({r["dst_address"] for r in near}),
            len({r["dst_port"] for r in near if r["dst_port"] is not None}),
            sum(r["packet_count"] for r in near), sum(r["byte_count"] for r in near),
            sum(r["state"] in FAIL for r in near), sum(r["duration_ms"] for r in near) / n,
            max(r["duration_ms"] for r in near), sum(r["byte_count"] for r in near) / n,
            t["second"] - max(same) if same else 0.0, not same)
    return out


@pytest.mark.parametrize("slice_seconds, crowd", [(300, 10**6), (1200, 10**6), (100_000, 10**6),
                                                  (300, 30), (100_000, 100)])
def test_against_brute_force(spark, make_flows, slice_seconds, crowd):
    """The same features whether sources are worked on in slices or, some or all, in blocks."""
    rng = random.Random(slice_seconds)
    rows = [dict(key=f"{rng.getrandbits(200):064x}", second=rng.randint(0, 3000),
                 sensor_id=rng.choice([None, "a"]), src_address=rng.choice(["192.0.2.1"] * 3
                                                                          + ["192.0.2.2"]),
                 dst_address=f"198.51.100.{rng.randint(1, 4)}",
                 dst_port=rng.choice([None, 1, 2, 3]), protocol=rng.choice(["tcp", "udp"]),
                 packet_count=rng.randint(0, 9), byte_count=rng.randint(0, 99),
                 duration_ms=rng.randint(0, 50), state=rng.choice(["REJ", "SF", None]))
            for _ in range(500)]
    flows = make_flows(rows)
    busy = busy_sources(flows, 300, slice_seconds, crowd)
    assert bool(busy) == (crowd < 10**6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", crowd == 10**6)
    got = window_features(flows, (60, 300), slice_seconds, crowd=crowd).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 500
    for w in (60, 300):
        want = brute(rows, w)
        for r in got:
            mine = tuple(r[f"w{w}_{n}"] for n in K.WINDOW_FEATURES)
            assert mine == pytest.approx(want[r["event_key"]]), (w, r["event_key"])


def test_bounds_ties_and_sensors(make_flows):
    rows = [{"second": 0, "key": "a"}, {"second": 240, "key": "b"}, {"second": 300, "key": "c"},
            {"second": 300, "key": "d"}, {"second": 299, "key": "e", "sensor_id": "x"}]
    got = {r["event_key"]: r for r in window_features(make_flows(rows)).collect()}
    assert got["c"]["w60_flow_count"] == 2 and got["c"]["w60_byte_total"] == 2000
    assert got["c"]["w300_flow_count"] == 3 and got["d"]["w60_flow_count"] == 3
    assert got["e"]["w60_flow_count"] == 1
    assert got["c"]["w60_seconds_since_prior_service"] == 60.0


def test_direct_features(make_flows):
    rows = [{"duration_ms": 0, "packet_count": 0, "state": "NEW", "protocol": "gre",
             "src_port": None, "dst_port": None}, {"byte_count": 10 ** 16, "duration_ms": 1}]
    zero, fast = FT.direct_features(make_flows(rows)).orderBy("event_key").collect()
    assert zero["bytes_per_second"] == 0.0 and zero["zero_duration"] and zero["zero_packets"]
    assert zero["connection_state"] == K.UNKNOWN_TOKEN and zero["src_port_class"] == "none"
    assert fast["bytes_per_second"] == K.RATE_CAP and fast["rate_clipped"]
    assert fast["quality_flags"] == ["bytes_per_packet_clipped", "bytes_per_second_clipped"]


def test_table_matrix_sink(spark, make_flows, tmp_path):
    table = FT.feature_table(make_flows([{"second": s} for s in range(5)]))
    assert len(table.columns) == 46 and len(set(table.columns)) == 46
    assert FT.model_matrix(table).columns == list(K.feature_names())
    with pytest.raises(ValueError):
        FT.model_matrix(table.withColumnRenamed("duration_ms", "label"))
    with pytest.raises(ValueError):
        FT.model_matrix(table, ["label"])
    manifest = FT.write_features(table, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert FT.verify(back, manifest).first()["intact"]
    assert not FT.verify(back.limit(4), manifest).first()["intact"]
    with pytest.raises(ValueError):
        FT.write_features(table.limit(0), str(tmp_path / "e"))


def test_overflow_is_an_error(make_flows):
    rows = [{"byte_count": 2 ** 62, "second": s} for s in (0, 1, 2)]
    with pytest.raises(Exception, match="(?i)overflow"):
        window_features(make_flows(rows)).collect()


def test_hash_does_not_depend_on_partitions(make_flows):
    flows = make_flows([{"second": s} for s in range(50)])
    a = FT.feature_table(flows.repartition(7)).select("event_key", "vector_hash", "snapshot_hash")
    b = FT.feature_table(flows.coalesce(1)).select("event_key", "vector_hash", "snapshot_hash")
    assert sorted(a.collect()) == sorted(b.collect())


def test_many_rows_are_dealt_to_more_tasks(spark, make_flows, monkeypatch):
    from flowguard.operators import windows
    flows = make_flows([dict(second=37 * i, src_address=f"192.0.2.{i % 7}", dst_port=i % 3)
                        for i in range(400)])
    want = sorted(map(str, window_features(flows).collect()))
    monkeypatch.setattr(windows, "TASK_ROWS", 20)
    got = window_features(flows)
    assert got.rdd.getNumPartitions() >= 20
    assert sorted(map(str, got.collect())) == want
