"""Registered queries: names, flagship, and a sample against their SQL (tools/compare.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.compare import TABLES, compare

SAMPLE = ["dedup_chain", "top_cities", "search_keyset", "facets", "salary_distribution_state", "visits_top", "activity_actions"]


def test_every_query_has_sql():
    assert set(contract.QUERIES) == set(contract.ORACLE_SQL)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert 0 < len(rows) <= 20 and list(rows[0].asDict()) == ["city", "state", "jobs", "salary_mid"]


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    line = compare(spark, con, name, sf_dir, contract.oracle_sql()[name])
    assert line.startswith("ok"), line
