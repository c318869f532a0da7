"""Landing, adapters, validation, lake layers, batch and stream jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stellwerk.operators import validate
from stellwerk.plans import jobs
from stellwerk.sources import lake, landing, status
from stellwerk.sources.adapters import ADAPTERS
from stellwerk.sources.unify import parse_source_list
from stellwerk.streaming.incremental import run_incremental

ADZUNA = [
    {
        "id": 1001,
        "title": " Data Engineer ",
        "description": "Python, SQL und Spark auf AWS",
        "company": {"display_name": "Beispiel GmbH"},
        "location": {"display_name": "Berlin", "area": ["Deutschland", "Berlin", "Mitte"]},
        "salary_min": 70000,
        "salary_max": "90000",
        "contract_time": "full_time",
        "category": {"tag": "it-jobs", "label": "IT Jobs"},
        "created": "2025-06-01T12:00:00Z",
    },
    {"id": "1002", "title": "", "location": {"area": ["D", "Bayern", "Oberbayern", "München"]}, "salary_max": -5.0},
    {"title": "ohne id"},
    "kein Objekt",
    7,
]


def line(items, envelope, page=1, at="2025-06-02T06:00:00Z", category="data_engineer"):
    body = items
    for name in reversed([p for p in envelope.split(".") if p]):
        body = {name: body}
    return json.dumps({"search_category": category, "page": page, "fetched_at": at, "body": body}, ensure_ascii=False)


def land(path, source, *lines):
    path.mkdir(parents=True, exist_ok=True)
    number = len(list(path.iterdir()))
    (path / f"{source}-{number:03d}.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def adapted(spark, tmp_path, source, items):
    path = land(tmp_path / source, source, line(items, landing.ENVELOPES[source]))
    return ADAPTERS[source](landing.read_landing(spark, source, path))


def test_adzuna(spark, tmp_path):
    rows = {r.source_id: r for r in adapted(spark, tmp_path, "adzuna", ADZUNA).collect()}
    assert set(rows) == {"1001", "1002", None}
    first, second = rows["1001"], rows["1002"]
    assert (first.title, first.city, first.state, first.salary_min, first.salary_max) == ("Data Engineer", "Mitte", "Berlin", 70000.0, None)
    assert (first.salary_present, first.currency, first.search_category, first.page) == (True, "EUR", "data_engineer", 1)
    assert (second.title, second.city, second.company) == ("Unbekannt", "München", None)


def test_arbeitnow_times_and_tags(spark, tmp_path):
    items = [
        {"slug": "a", "remote": True, "tags": ["x", "y", "z", "w"], "created_at": 1717243200, "job_types": ["Voll", "Teil"]},
        {"slug": "", "id": 5, "location": "Bonn", "created_at": "2024-06-01T14:00:00+02:00", "tags": []},
    ]
    df = adapted(spark, tmp_path, "arbeitnow", items).withColumn("at", F.date_format("posted_at", "yyyy-MM-dd HH:mm"))
    a, b = df.orderBy("source_id").collect()[::-1]
    assert (a.region, a.category_tag, a.category_label, a.contract_type, a.at) == ("Remote", "x", "x, y, z", "Voll, Teil", "2024-06-01 12:00")
    assert (b.source_id, b.region, b.city, b.category_label, b.contract_type, b.at) == ("5", "Deutschland", "Bonn", None, None, "2024-06-01 12:00")


def test_jobicy_lists_or_scalars(spark, tmp_path):
    items = [
        {"id": 1, "jobGeo": "Europe", "jobIndustry": ["Data", "IT"], "jobType": "full-time", "salaryMin": 0, "salaryMax": "50000"},
        {"id": 2, "jobGeo": "", "jobIndustry": [], "jobType": ["contract"]},
        {"id": 3, "jobGeo": "USA"},
    ]
    a, b = adapted(spark, tmp_path, "jobicy", items).orderBy("source_id").collect()
    assert (a.category_tag, a.contract_type, a.salary_min, a.salary_max) == ("Data", "full-time", None, 50000.0)
    assert (b.category_tag, b.contract_type, b.location) == (None, "contract", "")


def test_remoteok_notice_and_bundesagentur_coordinates(spark, tmp_path):
    rows = adapted(spark, tmp_path, "remoteok", [{"legal": "notice"}, {"id": "9", "position": "Dev", "url": "u"}]).collect()
    assert [(r.source_id, r.location, r.currency, r.url) for r in rows] == [("9", "Remote", "USD", "u")]
    items = [
        {"refnr": "r1", "beruf": "Informatiker", "arbeitsort": {"ort": "Ulm", "region": "BW", "koordinaten": {"lat": 48.4, "lon": 10.0}}},
        {"refnr": "r2", "titel": " Chef ", "arbeitsort": {"koordinaten": "keine"}, "eintrittsdatum": "2025-07-01"},
    ]
    a, b = adapted(spark, tmp_path, "bundesagentur", items).orderBy("source_id").collect()
    assert (a.title, a.latitude, a.location_segments, a.state) == ("Informatiker", 48.4, ["BW", "Ulm"], "BW")
    assert (b.title, b.latitude, b.url[-3:]) == ("Chef", None, "/r2")


def test_raw_page_files(spark, tmp_path):
    for source, body in (("jsearch", {"data": {"jobs": [{"job_id": "j", "job_title": "T"}, {"job_id": "k"}]}}), ("remoteok", [{"id": "1"}])):
        folder = tmp_path / source / "search_category=data_de" / "page=2" / "fetched_at=2025-06-02T06%3A00%3A00"
        folder.mkdir(parents=True)
        (folder / "answer.json").write_text(json.dumps(body, indent=1))
        rows = ADAPTERS[source](landing.read_raw_pages(spark, source, str(tmp_path / source))).collect()
        assert [(r.search_category, r.page) for r in rows] == [("data_de", 2)]


def test_source_list():
    assert parse_source_list(" Muse, nonsense,,ADZUNA ") == ["adzuna", "muse"]
    assert len(parse_source_list(None)) == 9 and parse_source_list("") == []


def run_landing(tmp_path):
    return {
        "adzuna": land(tmp_path / "in" / "adzuna", "adzuna", line(ADZUNA, "results"), line(ADZUNA[:1], "results", page=2), "{kaputt"),
        "jooble": land(tmp_path / "in" / "jooble", "jooble", line([{"id": "", "title": "x"}, {"id": 3, "title": "Data Engineer", "company": "beispiel gmbh"}], "jobs")),
    }


def test_ingest_splits_and_reports(spark, tmp_path):
    root = str(tmp_path / "lake")
    report = {r.source: r for r in jobs.ingest(spark, run_landing(tmp_path), root, "run1", "2025-06-02").collect()}
    assert (report["adzuna"].loaded, report["adzuna"].valid, report["adzuna"].quarantined) == (6, 3, 3)
    assert (report["jooble"].loaded, report["jooble"].valid) == (2, 1)
    bronze = lake.read_bronze_day(spark, f"{root}/{jobs.BRONZE}", "2025-06-02")
    assert bronze.count() == 4 and bronze.where("salary_max < 0").isEmpty()
    assert lake.read_bronze_day(spark, f"{root}/{jobs.BRONZE}", "2025-06-02", ["other"]).isEmpty()
    reasons = lake.read_quarantine(spark, f"{root}/{jobs.QUARANTINE}").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in reasons} == {"kein_dict": 3, "schema_verletzung": 1}
    assert list((tmp_path / "lake/bronze/postings/source=adzuna/year=2025/month=06/day=02").glob("category=data_engineer/run=run1/*.zstd.parquet"))
    jobs.ingest(spark, run_landing(tmp_path), root, "run1", "2025-06-02")
    again = lake.read_bronze(spark, f"{root}/{jobs.BRONZE}").where("source = 'jooble'")
    assert again.count() == 2  # landing now holds the posting twice; the files of the first attempt are gone


def test_bronze_day_prunes_partitions(spark, tmp_path):
    root = str(tmp_path / "lake")
    jobs.ingest(spark, run_landing(tmp_path), root, "run1", "2025-06-02")
    jobs.ingest(spark, run_landing(tmp_path), root, "run2", "2025-06-03")
    rows = lake.read_bronze_day(spark, f"{root}/{jobs.BRONZE}", "2025-06-02")
    # Folders of other days are not even listed.
    assert rows.count() > 0 and all("/year=2025/month=06/day=02/" in f for f in rows.inputFiles())
    assert lake.read_bronze_day(spark, f"{root}/{jobs.BRONZE}", "2024-06-02").count() == 0


def test_enabled_boards_only(spark, tmp_path):
    root = str(tmp_path / "lake")
    report = jobs.ingest(spark, run_landing(tmp_path), root, "r", "2025-06-02", enabled=" Jooble ,unknown")
    assert [r.source for r in report.collect()] == ["jooble"]
    with pytest.raises(ValueError):
        jobs.ingest(spark, run_landing(tmp_path), root, "r", "2025-06-02", enabled="muse")


def test_empty_writes(spark, tmp_path):
    empty = spark.createDataFrame([], "source string, search_category string, fetched_at timestamp")
    with pytest.raises(ValueError):
        lake.write_bronze(empty, str(tmp_path / "b"), "r")
    assert lake.write_quarantine(empty, str(tmp_path / "q"), "r") is False
    assert not (tmp_path / "q").exists()


def test_day_run_gold_and_status(spark, tmp_path):
    root = str(tmp_path / "lake")
    report, quality = jobs.run_day(spark, run_landing(tmp_path), root, "2025-06-02")
    assert quality.where("not ok").isEmpty()
    gold = lake.read_gold(spark, f"{root}/gold")
    jobs_seen = {(r.source, r.source_id) for r in gold["fact_jobs"].collect()}
    assert jobs_seen == {("adzuna", "1001"), ("adzuna", "1002")}  # the jooble posting is the same job
    assert {r.skill for r in gold["fact_skills"].collect()} == {"Python", "SQL", "Spark", "AWS"}
    assert lake.silver_day_exists(spark, f"{root}/{jobs.SILVER}", "2025-06-02")
    assert not lake.silver_day_exists(spark, f"{root}/{jobs.SILVER}", "2025-06-03")
    quota = spark.createDataFrame(
        [("jooble", 5, 500, 1.0, False, None)],
        "api string, used bigint, quota_limit bigint, percent double, monthly boolean, reset_date date",
    )
    status.write_run_status(status.run_status(report, "run1", "2025-06-02 06:00:00", quota), str(tmp_path / "status"))
    rows = {r.source: r for r in status.read_run_status(spark, str(tmp_path / "status")).collect()}
    assert len(rows) == 9 and rows["adzuna"].valid == 3 and rows["muse"].loaded == 0
    assert rows["jooble"].quota.used == 5 and rows["jsearch"].label == "JSearch (RapidAPI)"
    assert tuple(validate.status_summary(validate.source_status(report)).first()) == (0, 2)


def lake_state(spark, root):
    silver = lake.read_silver(spark, f"{root}/{jobs.SILVER}")
    return sorted((str(r.run_day), r.source, r.source_id, tuple(r.skills)) for r in silver.collect())


def test_stream_twice_equals_once_and_equals_batch(spark, tmp_path):
    paths = run_landing(tmp_path)
    root = str(tmp_path / "stream")
    gold = run_incremental(spark, paths, root, calendar_end="2025-12-31")
    once = lake_state(spark, root), lake.read_bronze(spark, f"{root}/{jobs.BRONZE}").count()
    assert gold["fact_jobs"].count() == 2
    run_incremental(spark, paths, root, calendar_end="2025-12-31")
    assert (lake_state(spark, root), lake.read_bronze(spark, f"{root}/{jobs.BRONZE}").count()) == once

    other = str(tmp_path / "batch")
    jobs.ingest(spark, paths, other, "r1")
    jobs.refresh_silver(spark, other, "2025-06-01", "2025-06-30")
    assert lake_state(spark, other) == once[0]

    later = [{"id": "2001", "title": "Neu", "description": "Rust"}]
    land(tmp_path / "in" / "adzuna", "adzuna", line(later, "results", at="2025-06-03T06:00:00Z"))
    gold = run_incremental(spark, paths, root, calendar_end="2025-12-31")
    assert gold["fact_jobs"].count() == 3
    days = {r.run_day for r in lake.read_silver(spark, f"{root}/{jobs.SILVER}").select("run_day").distinct().collect()}
    assert days == {dt.date(2025, 6, 2), dt.date(2025, 6, 3)}


def test_backfill_range_is_inclusive_and_leaves_other_days(spark, tmp_path):
    root = str(tmp_path / "lake")
    path = tmp_path / "in" / "adzuna"
    for day in range(1, 6):
        land(path, "adzuna", line([{"id": str(day), "title": f"T{day}"}], "results", at=f"2025-06-0{day}T06:00:00Z"))
    jobs.ingest(spark, {"adzuna": str(path)}, root, "r1")
    jobs.refresh_silver(spark, root, "2025-06-01", "2025-06-05")
    gold = jobs.backfill(spark, root, "2025-06-02", "2025-06-04")
    assert gold["fact_jobs"].count() == 5
    assert len(lake_state(spark, root)) == 5
