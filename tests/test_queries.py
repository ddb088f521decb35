"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, sf, name):
    good, note = compare(spark, connection, name, entry.queries()[name], ORACLES.get(name), sf)
    # On the smallest tables a query without SQL may have no rows; with SQL the rows have to agree.
    assert good or ORACLES.get(name) is None, note


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"source_table_name", "severity", "js_distance"} <= set(rows[0].asDict())


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())
