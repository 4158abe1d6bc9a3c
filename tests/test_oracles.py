"""Every registered query against its oracle SQL on the smallest tables."""

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name, entry.queries()[name], ORACLES.get(name))
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
