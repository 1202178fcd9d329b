"""The driver's contract: the flagship query, and every core query against its SQL."""

import pytest
from compare import connect, same_rows

import __spark_entry__ as entry
from tallyframe import data_queries, limit_queries, relation_queries, summary_queries

CORE = {k: f for part in (summary_queries, relation_queries, limit_queries, data_queries) for k, f in part.QUERIES.items()}
SQL = {k: s for part in (summary_queries, relation_queries, limit_queries, data_queries) for k, s in part.ORACLES.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, con, name):
    df = CORE[name](spark, sf)
    if name in SQL:
        same_rows(df, con, SQL[name])
    else:
        assert df.count() >= 0
