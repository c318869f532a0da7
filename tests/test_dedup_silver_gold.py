"""Deduplication rules, silver projection and star schema on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stellwerk.operators import dedup, gold, quality, silver
from stellwerk.schemas import BRONZE, SILVER
from stellwerk.sources import lake
from stellwerk.sources.unify import with_keys

T0 = dt.datetime(2025, 6, 1, 10, 0)


def bronze(spark, *rows):
    """Rows of (source, source_id, title, company, minutes after T0)."""
    data = [(s, i, t, c, T0 + dt.timedelta(minutes=m)) for s, i, t, c, m in rows]
    df = spark.createDataFrame(data, "source string, source_id string, title string, company string, fetched_at timestamp")
    keyed = with_keys(df)
    missing = [f for f in BRONZE.fields if f.name not in keyed.columns]
    return keyed.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def ids(df):
    return sorted((r.source, r.source_id) for r in df.collect())


def test_latest_keeps_newest(spark):
    df = bronze(spark, ("muse", "1", "A", "X", 0), ("muse", "1", "B", "X", 5), ("adzuna", "1", "A", "X", 1))
    assert sorted(r.title for r in dedup.dedup_latest(df).collect()) == ["A", "B"]


def test_batch_merges_same_hour_only(spark):
    df = bronze(
        spark,
        ("muse", "1", " Data Engineer", "X", 0),
        ("muse", "2", "data engineer ", "x ", 30),
        ("muse", "3", "data engineer", "X", 90),
        ("muse", "4", "data engineer", None, 0),
        ("muse", "5", "data engineer", "", 1),
    )
    assert ids(dedup.dedup_batch(df)) == [("muse", "2"), ("muse", "3"), ("muse", "5")]


def test_cross_source_prefers_board_then_time(spark):
    df = bronze(
        spark,
        ("remoteok", "1", "Müller", "Ä", 90),
        ("bundesagentur", "2", "muller", "a", 0),
        ("bundesagentur", "3", "MÜLLER", "A", 10),
        ("jsearch", "4", "other", "A", 0),
        ("muse", "5", "other", "A", 0),
    )
    assert ids(dedup.dedup_cross_source(df)) == [("bundesagentur", "3"), ("muse", "5")]


def test_survivors_are_unique_total_and_idempotent(spark):
    rows = [("muse", str(i % 50), f"T{i % 7}", f"C{i % 3}", i % 4) for i in range(600)]
    df = bronze(spark, *rows)
    once = dedup.dedup_bronze(df)
    again = dedup.dedup_bronze(once)
    shuffled = dedup.dedup_bronze(df.repartition(7))
    assert once.groupBy("dedup_key").count().where("count > 1").isEmpty()
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect())) == sorted(map(str, shuffled.collect()))


def test_group_limit_precedes_the_shuffle(spark):
    df = bronze(spark, ("muse", "1", "A", "X", 0))
    plan = dedup.dedup_latest(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") == 2


def test_stored_rows_give_the_same_survivors_and_shuffle_no_descriptions(spark, tmp_path):
    rows = [("muse", str(i % 60), f"T{i % 7}", f"C{i % 3}", i % 4) for i in range(900)]
    df = bronze(spark, *rows).withColumn("description", F.concat(F.lit("text "), "source_id"))
    df.repartition(5).write.parquet(str(tmp_path / "b"))
    stored = lake.located(spark.read.parquet(str(tmp_path / "b")))
    got = dedup.dedup_stored_bronze(stored)
    plain = dedup.dedup_bronze(df)
    key = ["source", "source_id", "title", "company", "fetched_at", "description"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, plain.select(key).collect()))
    windows = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line]
    assert windows and not any("description" in line for line in windows)


def test_wide_rows_are_never_sorted(spark, tmp_path):
    df = bronze(spark, ("muse", "1", "A", "X", 0), ("muse", "2", "B", "X", 0)).withColumn("description", F.lit("text"))
    df.write.parquet(str(tmp_path / "b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = dedup.dedup_stored_bronze(lake.located(spark.read.parquet(str(tmp_path / "b"))))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_scope_keeps_days_apart(spark):
    df = bronze(spark, ("muse", "1", "A", "X", 0), ("muse", "1", "A", "X", 60 * 24)).withColumn(
        "run_day", F.to_date("fetched_at")
    )
    assert dedup.dedup_bronze(df, ("run_day",)).count() == 2
    assert dedup.dedup_bronze(df).count() == 1


def test_place_and_salary_resolution(spark):
    rows = [
        ("Bonn", None, None, None, ["D", "NRW", "Köln"], 1.0, 3.0),
        (None, None, "Remote", "Ort", ["D", "", "Köln"], None, 3.0),
        (None, None, "Remote", "Ort", ["D", "NRW"], 1.0, None),
        (None, None, None, "Ort", [], None, None),
        (None, "Hessen", None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "city string, state string, region string, location string, seg array<string>, lo double, hi double",
    )
    c = F.col
    got = df.select(
        silver.resolve_city(c("city"), c("seg"), c("location")).alias("a"),
        silver.resolve_state(c("state"), c("seg"), c("region")).alias("b"),
        silver.salary_mid(c("lo"), c("hi")).alias("m"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Bonn", "NRW", 2.0),
        ("Köln", "Remote", 3.0),
        ("NRW", "NRW", 1.0),
        ("Ort", None, None),
        (None, "Hessen", None),
    ]


def staged(spark, *rows):
    """Rows of (job_id, title, company, city, skills)."""
    df = spark.createDataFrame(rows, "job_id string, title string, company string, city string, skills array<string>")
    df = df.withColumns(
        {
            "title_norm": F.lower(F.trim("title")),
            "company_norm": F.lower(F.trim(F.coalesce("company", F.lit("")))),
            "fetched_at": F.lit(T0),
            "source": F.lit("muse"),
        }
    )
    missing = [f for f in SILVER.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


@pytest.mark.parametrize("blank_company, expected", [(False, None), (True, "unbekannt")])
def test_unknown_company_only_if_a_blank_one_exists(spark, blank_company, expected):
    rows = [("1", "A", None, "Bonn", ["SQL"]), ("2", "B", "Acme", None, [])]
    if blank_company:
        rows.append(("3", "C", "", None, None))
    tables = gold.build_gold(staged(spark, *rows), "2023-02-01")
    joined = tables["fact_jobs"].join(tables["dim_company"], "company_id", "left")
    names = {r.job_id: r.company_norm for r in joined.select("job_id", "company_norm").collect()}
    assert names["1"] == expected and names["2"] == "acme"


def test_gold_tables_and_quality(spark):
    df = staged(
        spark, ("1", "A", "Acme", "Bonn", ["SQL", "Python", "SQL"]), ("2", "B", "ACME ", "Bonn", None), ("3", "C", "Z", None, ["R"])
    )
    tables = gold.build_gold(df, "2024-01-07")
    assert tables["dim_company"].count() == 2 and tables["dim_location"].count() == 2
    weights = {(r.job_id, r.skill): r.weight for r in tables["fact_skills"].collect()}
    assert weights == {("1", "SQL"): 2, ("1", "Python"): 1, ("3", "R"): 1}
    last = tables["dim_date"].orderBy(F.desc("date")).first()
    assert (last.date, last.iso_week, last.weekday_no, last.weekday) == (dt.date(2024, 1, 7), 1, 0, "Sonntag")
    report = quality.quality_report(tables)
    assert report.count() == 17 and report.where("not ok").isEmpty()
    broken = dict(tables, dim_location=tables["dim_location"].where("city = 'Bonn'"))
    bad = quality.quality_report(broken, ["SQL", "Python"]).where("not ok").collect()
    assert {(r.check_name, r.column_name, r.failures) for r in bad} == {
        ("relationships", "location_id", 1),
        ("accepted_values", "skill", 1),
    }


def test_fact_build_has_no_wide_shuffle(spark, tmp_path):
    staged(spark, ("1", "A", "Acme", "Bonn", ["SQL"])).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    dims = gold.build_dim_company(stored)
    plan = gold.build_fact_jobs(stored, dims)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert "Exchange" not in gold.build_fact_skills(stored)._jdf.queryExecution().executedPlan().toString()
