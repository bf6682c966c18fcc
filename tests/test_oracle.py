"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert differences(df, connection, ORACLES[name]) == []
    else:
        assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "id" and df.count() == 150


def test_sample_is_repeatable(spark):
    query = QUERIES["q_tablesample"]
    first, second = (sorted(r.o_orderkey for r in query(spark, SF).collect()) for _ in range(2))
    assert first == second
    assert 60 <= len(first) <= 260
