"""Every query with SQL gives the rows of that SQL."""

import pytest
from rows import duck_rows, spark_rows

from paritas import queries as core

QUERIES, SQL = core.all_queries(), core.all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(name, spark, sf, duck):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(duck, SQL[name])


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
