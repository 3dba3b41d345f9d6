"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01: tests/oracle_check.py)."""

import pytest

import __spark_entry__ as E
from helpers import SF_SMALL
from oracle_check import compare, duck
from trendlens.plans import catalog

QUERIES = {k: v for k, v in E.queries().items() if k in catalog.QUERIES}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert r["ok"] is not False, r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "topic", "raw_conversations", "raw_messages", "raw_users"]
    assert 0 < df.count() <= 10
