import pytest

from contract.landing_fixtures import landing
from stellwerk.session import configure
from stellwerk.sources.adapters import ADAPTERS


@pytest.fixture
def tables(spark, tmp_path):
    """One order line of one order, as the given tables have it."""
    rows = {
        "region": "0 r_regionkey, 'EUROPE' r_name",
        "nation": "0 n_nationkey, 'FRANCE' n_name, 0 n_regionkey",
        "supplier": "1L s_suppkey, 'Supplier 1' s_name, 0 s_nationkey",
        "part": "1L p_partkey, 'large ring' p_name, 'Brand#1' p_brand, 'PROMO' p_type, 25 p_size",
        "orders": "1L o_orderkey, '2-HIGH' o_orderpriority, timestamp_ntz'1997-03-04 05:06:07' o_orderdate",
        "lineitem": """1L l_orderkey, 1L l_partkey, 1L l_suppkey, 1 l_linenumber, 30D l_quantity, 100D l_extendedprice, 0.1D l_discount,
            0.02D l_tax, 'A' l_returnflag, 'F' l_linestatus, timestamp_ntz'1997-04-05 00:00:00' l_shipdate""",
    }
    for name, columns in rows.items():
        spark.sql(f"SELECT {columns}").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("source", ["jobicy", "adzuna", "jooble"])
def test_records_are_written_by_compiled_code(spark, tables, source):
    """Parsing is not compiled; a record that is written inside it is written by interpreted code as well."""
    rows = ADAPTERS[source](landing(spark, tables, source)).select("title", "company", "search_category")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    parsing = [line for line in plan.splitlines() if "from_json(" in line]
    assert parsing and not any("StructsToJson" in line for line in parsing)
    assert [tuple(r) for r in rows.collect()] == [("large ring", "Supplier 1", "PROMO")]


def test_sides_that_fit_a_task_are_hashed_not_sorted(spark):
    configure(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 5_000, 1, 3).selectExpr("id % 700 AS k", "id").join(spark.range(0, 700, 1, 2).withColumnRenamed("id", "k"), "k")
        assert rows.count() == len(rows.collect()) == 5_000
        final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
