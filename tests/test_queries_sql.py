"""Every registered query with SQL gives the SQL's rows on the smallest tables; every other gives rows."""

import os

import pytest

from tests.compare import spark_rows, sql_rows
from vidlake.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    columns, rows = spark_rows(catalogue.queries()[name](spark, DATA))
    assert columns
    if name in SQL:
        wanted = sql_rows(SQL[name], DATA)
        assert columns == wanted[0]
        assert len(rows) == len(wanted[1])
        assert rows == wanted[1]
