"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, duck
from conftest import SMALL

from vitrine.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows = compare(spark, con, SMALL, name, QUERIES[name], SQL.get(name))
    assert problem is None, problem
    if name not in SQL:
        assert rows > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
