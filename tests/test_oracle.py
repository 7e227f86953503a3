"""Every registered query with an SQL twin gives the same rows in DuckDB."""

import pytest

pytest.importorskip("duckdb")

import compare  # noqa: E402
from flowguard.plans import load_all  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = load_all()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query(spark, con, key):
    state, n, _, note = compare.compare(spark, con, FOLDER, key, QUERIES[key], ORACLE[key])
    assert state == "ok", note


def test_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
