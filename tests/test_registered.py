"""Every registered query against its SQL at the smallest scale."""

import re

import duckdb
import pytest
from check_oracle import compare

import __spark_entry__ as registry
from leafledger.plans.bridge import GIVEN

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in GIVEN:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


# The removable training-data queries have their own tests.
@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)))
def test_query_equals_sql(spark, duck, name):
    text, same = compare(spark, duck, SF, name, registry.queries()[name], registry.oracle_sql().get(name))
    assert same, text


def test_flagship_has_rows(spark):
    assert registry.entry(spark).count() > 0
