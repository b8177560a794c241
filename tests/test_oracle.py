"""Every registered query against its DuckDB oracle at sf0.01 (rows only where
no oracle exists)."""

import pytest

from foldwise.plans.registry import load
from tests.conftest import SF01
from tests.oracle_compare import compare, duck

QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF01)
    assert res["status"] in ("ok", "rows-only"), res
    assert res["rows"] > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["quality_rmse", "toxic_rmse", "mcrmse"]
