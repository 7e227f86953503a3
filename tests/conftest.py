import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowguard.session import build_session
    session = build_session("local[8]", 4, "flowguard-tests", spark__ui__enabled="false",
                            spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FLOW_DEFAULTS = dict(
    schema_version="1", source_type="zeek", source_event_id=None, sensor_id=None,
    src_address="192.0.2.1", dst_address="198.51.100.1", src_port=40000, dst_port=80,
    protocol="tcp", duration_ms=1000, packet_count=10, byte_count=1000, state="SF", metadata={},
    job_id="j", second=0)
FLOW_SCHEMA = ("schema_version string, source_type string, source_event_id string, "
               "sensor_id string, src_address string, dst_address string, src_port int, "
               "dst_port int, protocol string, duration_ms long, packet_count long, "
               "byte_count long, state string, metadata map<string,string>, job_id string, "
               "event_key string, event_time timestamp")


@pytest.fixture(scope="session")
def make_flows(spark):
    """Flows out of short dicts; ``second`` counts from a fixed base, ``key`` is the identity."""
    from datetime import datetime, timedelta, timezone
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def make(rows):
        out = []
        for i, row in enumerate(rows):
            full = {**FLOW_DEFAULTS, **row}
            at = base + timedelta(seconds=full.pop("second"))
            key = full.pop("key", f"{i:064x}")
            full = {k: full[k] for k in FLOW_DEFAULTS if k != "second"}
            out.append((*full.values(), key, at))
        return spark.createDataFrame(out, FLOW_SCHEMA)
    return make
