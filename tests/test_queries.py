"""Every query of the core with SQL gives the rows its SQL gives; those without run."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.compare import connect, rows, sql_rows

MODULES = [importlib.import_module(f"paperloom.plans.{m}") for m in entry._CORE]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    got = rows(QUERIES[name](spark, sf))
    if name in SQL:
        assert got == sql_rows(con, SQL[name])


def test_types_of_sql(con):
    """No SQL gives a type that has no like in Spark."""
    for name, sql in SQL.items():
        assert not [x for x in con.execute(sql).description if any(t in str(x[1]) for t in ("DECIMAL", "HUGE", "UBIGINT"))], name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
