from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.functions import contracts, network, text
from flowguard.operators import drift as D, fusion as FU, gates as G, matching as X, \
    retention as R, workflow as WF

NOW = datetime(2024, 1, 10, tzinfo=timezone.utc)


def one(df):
    return df.collect()[0]


SIGNAL = ("entity_id string, source string, score double, quality string, category string, "
          "evidence_hash string, reason_codes array<string>, position long")


def fuse(spark, *signals):
    rows = [("e", s, v, q, "scan" if q == "valid" else None, "h" if q == "valid" else None, codes, i)
            for i, (s, v, q, codes) in enumerate(signals)]
    return one(FU.fuse(spark.createDataFrame(rows, SIGNAL)))


def test_fusion_cases(spark):
    alone = fuse(spark, ("anomaly", 0.99, "valid", []))
    assert (alone["risk_score"], alone["confidence"], alone["severity"]) == (99, 0.166667, "critical")
    assert alone["uncertainty_codes"] == ["SINGLE_SOURCE"]
    mixed = fuse(spark, ("signature", 0.99, "valid", ["X"]), ("anomaly", 0.01, "valid", ["X"]),
                 ("supervised", 0.0, "absent", []))
    assert (mixed["risk_score"], mixed["severity"]) == (79, "high")
    assert mixed["uncertainty_codes"] == ["X", "SOURCE_SUPERVISED_ABSENT", "SIGNAL_DISAGREEMENT"]
    none = fuse(spark, ("signature", 0.9, "stale", []))
    assert (none["risk_score"], none["severity"], none["evidence_complete"]) == (
        0, "informational", False)
    assert none["uncertainty_codes"] == ["SOURCE_SIGNATURE_STALE", "NO_VALID_SIGNAL"]
    assert fuse(spark, ("anomaly", 0.1, "valid", []), ("anomaly", 0.2, "valid", []))[
        "duplicate_source"]
    half = fuse(spark, ("anomaly", 0.745, "valid", []))
    assert half["risk_score"] == 74


def test_drift(spark):
    def snap(value, n):
        return spark.createDataFrame([("missing_rate", value, n)],
                                     "metric_key string, value double, sample_count long")
    assert one(D.drift(snap(0.10, 50), snap(0.35, 50)))["status"] == "warning"
    assert one(D.drift(snap(0.10, 50), snap(0.60, 50)))["status"] == "critical"
    assert one(D.drift(snap(0.10, 2), snap(0.35, 50)))["status"] == "not_evaluable"
    assert one(D.drift(snap(0.1, 50), snap(0.1, 50), samples=(5, 50)))["status"] == "not_evaluable"


def test_indicator_matching(spark):
    def hashed(kind, raw):
        return one(spark.range(1).select(text.indicator_hash(F.lit(kind), F.lit(raw)).alias("h")))["h"]
    values = [("ipv4", "192.0.2.1", 5), ("domain", "bad.example", 5), ("ipv6", "2001:db8::1", -5),
              ("url", "http://x.example/p", 5)]
    indicators = spark.createDataFrame(
        [(k, hashed(k, v), f"i{i}", "feed", NOW + timedelta(days=d))
         for i, (k, v, d) in enumerate(values)],
        "indicator_type string, value_hash string, indicator_hash string, source_name string, "
        "expires_at timestamp")
    seen = spark.createDataFrame(
        [("ipv4", " 192.0.2.1", "a"), ("domain", "BAD.example.", "b"),
         ("ipv6", "2001:0db8:0::1", "c"), ("ipv4", "192.0.2.77", "d"), ("ipv4", "nope", "e")],
        "indicator_type string, raw_value string, provenance_hash string")
    listed = spark.createDataFrame([(hashed("ipv4", "192.0.2.1"),)], "value_hash string")
    got = {r["provenance_hash"]: r["state"] for r in
           X.match_indicators(indicators, seen, listed, NOW).collect()}
    assert got == {"a": "allowlist_conflict", "b": "active", "c": "expired"}


@pytest.mark.parametrize("kind,raw,want", [
    ("url", "HTTPS://User@Host.Example:8080/a/b?q=1#f", "https://host.example/a/b"),
    ("url", "ftp://host/a", None), ("url", "http://", None), ("domain", "a b.example", None),
    ("domain", "A.Example..", "a.example"), ("ipv4", "2001:db8::1", None),
    ("ipv6", "2001:DB8:0:0::1", "2001:db8::1"), ("sha256", "A" * 64, "a" * 64),
    ("sha256", "a" * 63, None), ("ipv4", "01.2.3.4", None)])
def test_indicator_values(spark, kind, raw, want):
    assert one(spark.range(1).select(text.normalize_indicator(F.lit(kind), F.lit(raw))))[0] == want


def test_targets(spark):
    cases = [("external_ip", "203.0.113.9", True), ("external_ip", "10.0.0.1", False),
             ("internal_ip", "10.0.0.1", True), ("internal_ip", "fd00::1", True),
             ("external_ip", "224.0.0.1", False), ("external_ip", "::", False),
             ("external_ip", " 203.0.113.9", False), ("external_domain", "a.example", True),
             ("external_domain", "rm -rf /", False), ("command", "203.0.113.9", False),
             ("external_ip", "2001:db8::1", True)]
    df = spark.createDataFrame(cases, "k string, v string, want boolean")
    got = df.select("want", network.is_valid_target(F.col("k"), F.col("v")).alias("ok"))
    assert all(r["want"] == r["ok"] for r in got.collect())


def test_notes(spark):
    df = spark.createDataFrame(
        [(1, "seen 192.0.2.1 and fe80::1:2\x00 é"), (2, " \x01 "), (3, "x" * 4097), (4, None)],
        "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", text.sanitize_note(F.col("t")).alias("n")).collect()}
    assert got[1]["body"] == f"seen {K.REDACTED_ENDPOINT} and {K.REDACTED_ENDPOINT} é"
    assert [got[i]["error"] for i in (2, 3, 4)] == ["note_empty", "note_too_large", "note_empty"]


BASE = dict(request_id=1, environment="simulation", has_permission=True, target_type="external_ip",
            target_value="203.0.113.9", allowlist_match=False, target_is_critical=False,
            evidence_present=True, corroborated=True, model_only=False, intelligence_used=False,
            intelligence_sole=False, intelligence_fresh=True, duration_seconds=60, has_expiry=True,
            has_rollback_plan=True, duplicate_detected=False, cooldown_active=False)
MUTATIONS = [("environment", dict(environment="lab")), ("authorization", dict(has_permission=False)),
             ("target_validity", dict(target_value="nope")),
             ("internal_external", dict(target_type="internal_ip", target_value="10.0.0.1")),
             ("allowlist", dict(allowlist_match=True)),
             ("critical_asset", dict(target_is_critical=True)),
             ("evidence", dict(corroborated=False)), ("model_anomaly_only", dict(model_only=True)),
             ("intelligence_freshness", dict(intelligence_used=True, intelligence_sole=True)),
             ("duration", dict(duration_seconds=86_401)), ("rollback", dict(has_rollback_plan=False)),
             ("duplicate_replay", dict(duplicate_detected=True)),
             ("rate_cooldown", dict(cooldown_active=True))]


def test_each_gate(spark):
    rows = [{**BASE}] + [{**BASE, **m, "request_id": i + 2} for i, (_, m) in enumerate(MUTATIONS)]
    rows.append({**BASE, "request_id": 99, "intelligence_used": True, "intelligence_fresh": False})
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}"
                       for k, v in BASE.items())
    ctx = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    gates = G.evaluate_gates(ctx)
    assert sorted(G.decide(ctx).collect()) == sorted(G.decisions(gates).collect())
    assert gates.count() == 13 * len(rows)
    got = {r["request_id"]: r for r in G.decisions(gates).collect()}
    assert got[1]["eligible"] and got[99]["eligible"]
    for i, (gate, _) in enumerate(MUTATIONS):
        assert got[i + 2]["first_failure"] == gate and got[i + 2]["passed_gates"] == 12


def step(i, entity, current, target, disposition=None):
    return (entity, NOW + timedelta(hours=5 * i), i, str(i), current, target, disposition)


def test_composition_equals_the_standard_and_needs_no_python(spark):
    import random
    import unicodedata
    g = random.Random(7)
    # Assigned since long ago, so both libraries know them.
    chars = [chr(i) for i in range(32, 0x3100) if unicodedata.ucd_3_2_0.category(chr(i)) not in ("Cn", "Cs")]
    marks = [c for c in chars if unicodedata.combining(c)]
    jamo = [chr(g.randint(0x1100, 0x11FF)) for _ in range(40)] + [chr(g.randint(0xAC00, 0xD7A3)) for _ in range(40)]
    texts = ["".join(g.choice(g.choice([chars, marks, marks, jamo, ["A", "e", "o"]])) for _ in range(g.randint(0, 12)))
             for _ in range(3000)] + chars + [unicodedata.normalize("NFD", c) for c in chars] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.nfc(F.col("t")).alias("n"))
    got = dict(map(tuple, df.collect()))
    assert [i for i, t in enumerate(texts) if t is not None and got[i] != unicodedata.normalize("NFC", t)] == []
    assert got[len(texts) - 1] is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


STEP = ("entity_id string, at timestamp, seq long, step_id string, current string, target string, "
        "disposition string")


@pytest.mark.parametrize("chunk", [2, 3, 256])
def test_alert_fold(spark, chunk):
    rows = [step(1, "a", "new", "acknowledged"), step(2, "a", "new", "acknowledged"),
            step(3, "a", "acknowledged", "closed"), step(4, "a", "acknowledged", "closed", "benign"),
            step(5, "a", "closed", "investigating"), step(6, "b", "new", "closed", "benign")]
    done = WF.fold_transitions(spark.createDataFrame(rows, STEP), K.ALERT_TRANSITIONS, "new",
                               chunk=chunk)
    got = {int(r["step_id"]): (r["accepted"], r["error"]) for r in done.collect()}
    assert got == {1: (True, None), 2: (False, "state_conflict"),
                   3: (False, "close_requires_disposition"), 4: (True, None), 5: (True, None),
                   6: (False, "invalid_transition")}
    last = {r["entity_id"]: (r["state"], r["disposition"]) for r in
            WF.final_states(done, "new").collect()}
    assert last == {"a": ("investigating", None), "b": ("new", None)}


@pytest.mark.parametrize("crowd", [10 ** 6, 50])
def test_fold_of_one_long_history(spark, crowd):
    """Several levels of chunks, whether one task or blocks rank the steps."""
    import random
    g = random.Random(crowd)
    rows = [(g.choice(["big", "big", "big", "e1", "e2"]), NOW + timedelta(seconds=g.randint(0, 900)), i,
             str(i), g.choice("abcd"), g.choice("abcd"), g.random() < .8) for i in range(3000)]
    steps = spark.createDataFrame(rows, "e string, at timestamp, seq long, step_id string, "
                                        "expected string, target string, legal boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r["step_id"]: (r["before"], r["accepted"]) for r in
           WF.fold_steps(steps, "e", F.lit("a"), chunk=8, crowd=crowd).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state, want = {}, {}
    for e, _, _, i, expected, target, legal in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        was = state.get(e, "a")
        good = legal and expected == was
        want[i] = (was, good)
        state[e] = target if good else was
    assert got == want


def test_contracts_and_retention(spark):
    row = spark.range(1).select(
        F.lit("valid").alias("quality"), F.lit("anomaly").alias("source"), F.lit(0.5).alias("score"),
        F.lit(None).cast("string").alias("evidence_hash"), F.lit("c").alias("category"))
    assert not one(row.select(contracts.fusion_input_ok()))[0]
    old, young = NOW - timedelta(days=31), NOW - timedelta(days=1)
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    kept = R.expire_detection(
        t([(1, young)], "alert_id long, created_at timestamp"),
        t([(1, 1, 10), (2, 1, 11)], "evidence_id long, alert_id long, signal_id long"),
        t([(10, 5, old), (11, 6, young)], "signal_id long, run_id long, created_at timestamp"),
        t([(1, old)], "event_id long, created_at timestamp"),
        t([(5, old), (6, old)], "run_id long, created_at timestamp"), NOW)
    assert kept["alerts"].count() == 1 and kept["signatures"].count() == 0
    assert {r["evidence_id"]: r["signal_id"] for r in kept["evidence"].collect()} == {1: None, 2: 11}
    assert [r["run_id"] for r in kept["runs"].collect()] == [6]


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(2000).selectExpr("id AS request_id", "IF(id < 5, id, NULL) AS alert_id")
    side = spark.range(3).selectExpr("id AS alert_id", "id * 2 AS twice")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = G.look_up(rows, side.hint("merge"), "alert_id")
        held = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        found = {r["request_id"]: r["twice"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in held) < 1000 and len(held) > 2
    assert len(found) == 2000 and {k: v for k, v in found.items() if v is not None} == {
        0: 0, 1: 2, 2: 4}
