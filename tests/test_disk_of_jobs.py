"""What a job of several queries holds on disk: shuffles go with their query, long rows are not shuffled, inputs are made once."""

import datetime as dt
import time

from pyspark.sql import functions as F

from contract import fixtures as fx
from contract.landing_fixtures import landing_pages
from contract.spark_side import QUERIES
from stellwerk.operators import dedup
from stellwerk.plans import gold_upkeep
from stellwerk.plans.scratch import written_once
from stellwerk.schemas import SILVER
from stellwerk.session import configure
from stellwerk.sources import lake
from stellwerk.sources.unify import with_keys


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_when_their_query_ends(spark):
    configure(spark)
    before = shuffle_files(spark)
    with written_once(spark.range(50_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count("*").alias("n")), "sums") as rows:
        for _ in range(50):
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.2)
        assert not left and rows.count() == 7_000
    # A frame that is asked twice gives its rows again.
    sums = spark.range(2_000).groupBy((F.col("id") % 30).alias("k")).agg(F.count("*").alias("n"))
    assert sorted(sums.collect()) == sorted(sums.collect())


def silver(spark, days):
    """Two postings have no company, every third has no title."""
    rows = []
    for day in days:
        for i in range(40):
            given = {"job_id": f"j{i}", "source": "muse", "source_id": str(i), "title": f"T{i % 5}", "title_norm": None if i % 3 == 0 else f"t{i % 5}"}
            given |= {"description": f"text {day} {i}", "company_norm": "" if i < 2 else f"c{i % 4}", "skills": ["a"], "run_day": dt.date(2025, 6, day)}
            rows.append(tuple(given.get(f.name) for f in SILVER))
    return spark.createDataFrame(rows, SILVER)


def test_wanted_rows_of_silver_are_not_shuffled(spark, tmp_path):
    rows = silver(spark, (1, 2, 3))
    lake.write_silver(rows, str(tmp_path / "s"))
    stored = lake.read_silver(spark, str(tmp_path / "s"))
    some = rows.where("(run_day = '2025-06-01' AND source_id < 2) OR (run_day = '2025-06-03' AND source_id > 30)")
    wanted = gold_upkeep._by_key(some.select("job_id", "run_day", "title_norm", "company_norm"), 8)
    columns = [*SILVER.fieldNames(), "bucket"]
    with gold_upkeep._wide(stored, wanted, 8) as found:
        assert "Exchange hashpartitioning" not in plan(found)
        got = found.select(columns).collect()
    expected = gold_upkeep._by_key(some, 8).select(columns).collect()
    assert len(expected) > 5 and sorted(map(str, got)) == sorted(map(str, expected))
    with gold_upkeep._wide(stored, wanted.limit(0), 8) as none:
        assert none.isEmpty()


def test_stored_keys_are_not_made_again(spark, tmp_path):
    rows = spark.range(60).select(
        F.lit("muse").alias("source"), (F.col("id") % 40).cast("string").alias("source_id"), F.concat(F.lit("T"), F.col("id") % 7).alias("title"),
        F.concat(F.lit("C"), F.col("id") % 3).alias("company"), F.lit(dt.datetime(2025, 6, 1)).alias("fetched_at"), F.col("id").alias("posted_at"),
    )
    for name, given in (("keyed", with_keys(rows)), ("plain", rows)):
        given.write.parquet(str(tmp_path / name))
        rule = dedup.bronze_rules((), [F.asc("posted_at")], with_keys)
        last = rule.rest(lake.located(spark.read.parquet(str(tmp_path / name))))
        assert ("sha2(" in plan(last)) == (name == "plain")
        wanted = dedup.dedup_cross_source(with_keys(rows), (), [F.asc("posted_at")]).select(rows.columns)
        assert sorted(last.select(rows.columns).collect()) == sorted(wanted.collect())


def test_rules_of_the_contract_read_stored_rows(spark, sf_dir):
    for name, shuffles in (("dedup_across_days", 1), ("dedup_title_company", 1), ("dedup_chain", 3)):
        assert plan(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == shuffles
    columns = ["job_id", "run_day", "title", "company", "city", "salary_mid", "description", "skills", "dedup_key"]
    stored, lazy = (rows.select(columns) for rows in (fx.stored_silver(spark, sf_dir), fx.silver(spark, sf_dir)))
    assert sorted(map(str, stored.collect())) == sorted(map(str, lazy.collect()))


def test_pages_of_a_board_from_stored_rows(spark, sf_dir):
    with written_once(fx.bronze(spark, sf_dir).drop(*dedup.DERIVED), "bronze") as rows:
        for source in ("jsearch", "jobicy"):
            # The order of postings on a page is free.
            pages = [landing_pages(spark, sf_dir, source, *given).select("run_day", F.length("value")) for given in ((), (rows,))]
            got, wanted = (sorted(map(str, p.collect())) for p in pages)
            assert got and got == wanted
            assert "Join" not in plan(landing_pages(spark, sf_dir, source, rows))
