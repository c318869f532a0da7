"""Long rows are not shuffled by rules that look at few columns, and keys not by the bronze writer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stellwerk.operators import dedup
from stellwerk.plans.scratch import kept_by
from stellwerk.schemas import BRONZE
from stellwerk.session import RUNTIME_CONF
from stellwerk.sources import lake
from stellwerk.sources.unify import with_keys

T0 = dt.datetime(2025, 6, 1, 10, 0)


def bronze(spark, n):
    data = [("muse", str(i % 70), f"T{i % 9}", None if i % 5 == 0 else f"C{i % 4}", T0 + dt.timedelta(minutes=i % 6)) for i in range(n)]
    df = spark.createDataFrame(data, "source string, source_id string, title string, company string, fetched_at timestamp")
    texts = {"description": F.concat(F.lit("text "), "source_id"), "url": F.concat(F.lit("https://x/"), "source_id"), "search_category": F.lit("a/b")}
    keyed = with_keys(df).withColumns(texts)
    return keyed.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in BRONZE.fields if f.name not in keyed.columns])



def test_survivors_are_fetched_without_a_shuffle(spark, tmp_path):
    df = bronze(spark, 900)
    df.repartition(5).write.parquet(str(tmp_path / "b"))
    stored = lake.located(spark.read.parquet(str(tmp_path / "b")))
    with kept_by(stored, dedup.bronze_rules()) as got:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        rows = sorted(map(str, got.select(*df.columns).collect()))
    assert rows == sorted(map(str, dedup.dedup_stored_bronze(stored).select(*df.columns).collect()))
    plain = dedup.dedup_bronze(df)
    key = ["source", "source_id", "title", "company", "fetched_at", "description"]
    with kept_by(stored, dedup.bronze_rules()) as got:
        assert sorted(map(str, got.select(key).collect())) == sorted(map(str, plain.select(key).collect()))


def test_every_bit_of_a_bitmap(spark, tmp_path):
    """More rows than one bitmap has bits, in one file."""
    spark.range(0, 70_000, 1, 1).write.parquet(str(tmp_path / "n"))
    stored = lake.located(spark.read.parquet(str(tmp_path / "n")))
    third = F.col("id") % 3 == 0
    with kept_by(stored, lambda df: df.where(third)) as got:
        assert got.where(third).count() == got.count() == 23_334


def test_default_ties_are_hashed_once(spark, tmp_path):
    bronze(spark, 50).write.parquet(str(tmp_path / "b"))
    stored = lake.located(spark.read.parquet(str(tmp_path / "b")))
    plan = dedup.kept_positions(stored, dedup.bronze_rules())._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Sort [" in line]
    assert windows and plan.count("xxhash64(") == 1


def test_bronze_is_written_without_being_looked_for(spark, tmp_path, monkeypatch):
    df = bronze(spark, 300)

    def looked(self):
        raise AssertionError("the rows are computed twice")

    monkeypatch.setattr(type(df), "isEmpty", looked)
    lake.write_bronze(df, str(tmp_path / "w"), "r")
    found = lake.read_bronze(spark, str(tmp_path / "w"))
    columns = ["source_id", "title", "company", "job_id", "dedup_key", "source_priority"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, df.select(columns).collect()))
    assert {(r.year, r.month, r.day, r.category, r.run) for r in found.collect()} == {("2025", "06", "01", "a_b", "r")}
    with pytest.raises(ValueError):
        lake.write_bronze(df.limit(0), str(tmp_path / "none"), "r")


def test_tasks_are_small(spark):
    for name in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        assert RUNTIME_CONF[name] == "16m" == spark.conf.get(name)
