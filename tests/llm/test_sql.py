"""Operators that SQL can express, against DuckDB over the same tables."""

import duckdb
import pytest
from check_oracle import compare

import __spark_entry__ as registry
from leafledger.llm import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    text, same = compare(spark, con, SF, name, plans.QUERIES[name], plans.SQL[name])
    assert same, text


def test_every_operator_is_registered():
    names = set(registry.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert "pipeline" in names and registry.oracle_sql().keys() <= names
