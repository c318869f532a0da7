"""Gold after changed days against gold built from all days; one version for readers; emptied days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stellwerk.operators.dedup import staging
from stellwerk.operators.gold import build_gold
from stellwerk.plans import gold_upkeep
from stellwerk.schemas import SILVER
from stellwerk.sources import lake, versions

END = "2026-12-31"


def observation(rng, day, job):
    title = rng.choice(["Dev", "Ops", "Data", "Chef", "QA"])
    company = rng.choice([None, "Acme", "ACME ", "Beta", "Gamma"])
    at = dt.datetime(2025, 6, day, rng.randrange(3))
    return {
        "job_id": f"j{job}", "source": "muse", "source_id": str(job), "title": title, "title_norm": title.lower(),
        "description": f"text {rng.randrange(3)}", "company": company, "company_norm": (company or "").strip().lower(),
        "city": rng.choice(["Ulm", "Bonn", None]), "state": rng.choice(["BW", None]), "region": None,
        "salary_min": None, "salary_max": None, "salary_mid": float(rng.randrange(3)), "currency": None, "contract_type": None,
        "contract_time": None, "category": None, "posted_at": rng.choice([None, at]), "fetched_at": at,
        "skills": rng.choice([["a"], ["a", "b", "a"], []]), "url": None, "dedup_key": "k", "run_day": dt.date(2025, 6, day),
    }


def write_day(spark, root, day, rows):
    df = spark.createDataFrame([tuple(r[f.name] for f in SILVER) for r in rows], SILVER)
    lake.write_silver(df, root, [dt.date(2025, 6, day)])


def state(tables):
    return {name: sorted(map(str, df.select(*sorted(df.columns)).collect())) for name, df in tables.items()}


def test_updates_equal_full_builds(spark, tmp_path):
    rng = random.Random(11)
    silver, root = str(tmp_path / "silver"), str(tmp_path / "gold")
    days = {d: [observation(rng, d, j) for j in rng.sample(range(30), 12)] for d in (1, 2, 3)}
    for d, rows in days.items():
        write_day(spark, silver, d, rows)

    def both():
        updated = gold_upkeep.refresh(spark, silver, root, END, buckets=4)
        rows = lake.read_silver(spark, silver)
        ties = [F.desc_nulls_last("posted_at"), F.asc("title"), F.asc_nulls_first("company"), *gold_upkeep._order()[-2:]]
        prints = gold_upkeep._observations(rows).select("job_id", "run_day", "short", "whole")
        full = build_gold(staging(rows.join(prints, ["job_id", "run_day"]), ties), END)
        assert state(updated) == state(full)
        return updated

    both()
    for step in range(5):
        if step == 0:  # the last day grows, as with a second run on that day
            days[3] = days[3] + [observation(rng, 3, j) for j in range(30, 34)]
            write_day(spark, silver, 3, days[3])
        elif step == 1:  # a new day
            write_day(spark, silver, 4, [observation(rng, 4, j) for j in rng.sample(range(40), 15)])
        elif step == 2:  # the latest day loses most of its postings, whose earlier days count again; an old one is rewritten
            write_day(spark, silver, 4, [observation(rng, 4, 1)])
            write_day(spark, silver, 2, [observation(rng, 2, j) for j in rng.sample(range(30), 9)])
        elif step == 3:  # a day is emptied
            write_day(spark, silver, 3, [])
            assert lake.read_silver(spark, silver).where("run_day = '2025-06-03'").isEmpty()
        both()
    assert (versions.current(spark, root).notes["days"]).keys() == {"2025-06-01", "2025-06-02", "2025-06-04"}


def test_unknown_company_comes_and_goes(spark, tmp_path):
    rng = random.Random(1)
    silver, root = str(tmp_path / "silver"), str(tmp_path / "gold")
    row = observation(rng, 1, 1) | {"company": None, "company_norm": "", "title": "A", "title_norm": "a"}
    blank = observation(rng, 2, 2) | {"company": "", "company_norm": "", "title": "B", "title_norm": "b"}
    write_day(spark, silver, 1, [row])
    assert [r.company_id for r in gold_upkeep.refresh(spark, silver, root, END, buckets=4)["fact_jobs"].collect()] == [None]
    write_day(spark, silver, 2, [blank])
    ids = {r.job_id: r.company_id for r in gold_upkeep.refresh(spark, silver, root, END)["fact_jobs"].collect()}
    assert ids["j1"] == ids["j2"] is not None
    write_day(spark, silver, 2, [])
    assert [r.company_id for r in gold_upkeep.refresh(spark, silver, root, END)["fact_jobs"].collect()] == [None]


def test_update_reads_only_changed_days_and_touched_buckets(spark, tmp_path):
    rng = random.Random(2)
    silver, root = str(tmp_path / "silver"), str(tmp_path / "gold")
    for d in range(1, 6):
        write_day(spark, silver, d, [observation(rng, d, 100 * d + j) | {"title": f"T{100 * d + j}", "title_norm": f"t{100 * d + j}"} for j in range(20)])
    gold_upkeep.refresh(spark, silver, root, END, buckets=64)
    before = versions.current(spark, root)
    write_day(spark, silver, 6, [observation(rng, 6, 999)])
    gold_upkeep.refresh(spark, silver, root, END)
    after = versions.current(spark, root)
    for name in ("latest", "candidates", "fact_jobs", "fact_skills"):
        old, new = before.tables[name]["folders"], after.tables[name]["folders"]
        assert sum(old.get(b) != f for b, f in new.items()) <= 1
    assert lake.read_gold(spark, root)["fact_jobs"].count() == 101
    # Nothing new: no bucket is written.
    gold_upkeep.refresh(spark, silver, root, END)
    again = versions.current(spark, root)
    assert again.tables["fact_jobs"] == after.tables["fact_jobs"]


def test_reader_keeps_its_version_and_failed_writes_change_nothing(spark, tmp_path):
    root = str(tmp_path / "gold")
    numbers = lambda n: {"t": spark.range(n).withColumnRenamed("id", "n"), "u": spark.range(2 * n)}
    versions.write_version(spark, root, numbers(10))
    first = versions.current(spark, root)
    reader = versions.read_table(spark, root, first, "t")
    versions.write_version(spark, root, numbers(20))
    assert reader.count() == 10
    second = versions.current(spark, root)
    with pytest.raises(Exception):
        versions.write_version(spark, root, {"t": spark.range(5), "u": spark.range(5).select(F.raise_error(F.lit("broken")).alias("x"))})
    assert versions.current(spark, root) == second
    assert versions.read_table(spark, root, second, "t").count() == 20 and versions.read_table(spark, root, second, "u").count() == 40
    versions.write_version(spark, root, numbers(30))
    kept = {p.name for p in (tmp_path / "gold" / "_versions").iterdir() if any(p.iterdir())}
    assert kept == {f.split("/")[1] for s in (second, versions.current(spark, root)) for f in s.folders()}


def test_buckets_that_become_empty(spark, tmp_path):
    root = str(tmp_path / "t")
    change = versions.Change(spark, root)
    change.put_buckets("t", spark.range(20).withColumn("bucket", F.expr("cast(id % 4 as int)")))
    change.publish()
    change = versions.Change(spark, root)
    change.put_buckets("t", spark.range(100, 102).withColumn("bucket", F.lit(1)), [0, 1])
    done = change.publish()
    rows = versions.read_table(spark, root, done, "t")
    assert sorted(r.id for r in rows.collect()) == sorted([100, 101] + [i for i in range(20) if i % 4 > 1])
    assert versions.read_table(spark, root, done, "t", [0]).count() == 0
    assert versions.read_table(spark, root, done, "t", [1]).count() == 2
