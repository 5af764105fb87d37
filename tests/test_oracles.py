"""Every registered query against its DuckDB oracle (or a row check when it has none)."""

import pytest

import __spark_entry__ as entry
from salient.plans.verify import compare, duck
from tests.conftest import SMOKE

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SMOKE).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = con.execute(ORACLES[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["label", "mean_score", "n"]
