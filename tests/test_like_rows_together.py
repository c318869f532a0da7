"""Shuffles of the bronze layer: like rows side by side, numbers in place of file names."""

import datetime as dt

from pyspark.sql import functions as F

from stellwerk.operators import dedup
from stellwerk.plans import scratch
from stellwerk.schemas import BRONZE
from stellwerk.sources import lake
from stellwerk.sources.unify import with_keys

T0 = dt.datetime(2025, 6, 1, 10, 0)


def bronze(spark, n):
    """Repeated ids, titles and companies on three boards, some of them null, some rows twice."""
    data = [
        (("muse", "adzuna", "jobicy")[i % 3], None if i % 41 == 0 else str(i % 230), None if i % 37 == 0 else f"T{i % 9}", None if i % 5 == 0 else f"C{i % 4}", T0 + dt.timedelta(minutes=40 * (i % 6)), i % 7)
        for i in [*range(n), *range(n // 10)]
    ]
    df = spark.createDataFrame(data, "source string, source_id string, title string, company string, fetched_at timestamp, l_linenumber int")
    texts = {"description": F.concat(F.lit("text "), "title"), "url": F.concat(F.lit("https://x/"), "source_id"), "search_category": F.lit("a/b")}
    keyed = with_keys(df).withColumns(texts)
    return keyed.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in BRONZE.fields if f.name not in keyed.columns])


def test_bronze_rows_are_sorted_before_their_shuffle(spark, tmp_path):
    df = bronze(spark, 300)
    plan = lake._bronze_rows(df, "r", None)._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffle = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line)
    assert any("Sort [" in line and "title" in line for line in plan[shuffle:])
    lake.write_bronze(df, str(tmp_path / "w"), "r")
    columns = ["source_id", "title", "company", "fetched_at", "job_id", "dedup_key", "source_priority", "url"]
    found = lake.read_bronze(spark, str(tmp_path / "w")).select(columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, df.select(columns).collect()))


def test_a_search_for_repeats_shuffles_a_hash_and_a_position(spark, tmp_path):
    bronze(spark, 300).repartition(3).write.parquet(str(tmp_path / "b"))
    stored = lake.located(spark.read.parquet(str(tmp_path / "b")))
    with scratch.written_once(dedup.numbered_files(stored), "files") as files:
        names = [r[0] for r in files.orderBy("_number").select("_file").collect()]
        assert names == sorted(names) and len(names) == 3
        rows = dedup.with_numbers(stored, files)
        for key, _ in dedup.bronze_rules(("posted_at",)).steps:
            plan = dedup.alone_positions(rows, key)._jdf.queryExecution().executedPlan().toString()
            sent = next(line for line in plan.splitlines() if "partial_count" in line)
            assert "output=[_key" in sent or "keys=[_key" in sent
            assert not any(c in sent for c in ("title", "company", "source", "_metadata"))
        alone = dedup.with_names(dedup.alone_positions(rows, ["source", "source_id"]), files)
        found = sorted(map(str, dedup.fetched(stored, alone).select("source", "source_id").collect()))
    wanted = bronze(spark, 300).groupBy("source", "source_id").count().where("count = 1").select("source", "source_id")
    assert found and found == sorted(map(str, wanted.collect()))


def test_steps_keep_the_rows_the_rules_keep(spark, tmp_path, monkeypatch):
    rows = bronze(spark, 900)
    rows.repartition(4).write.parquet(str(tmp_path / "b"))
    stored = lake.located(spark.read.parquet(str(tmp_path / "b")))
    ties = [F.asc("l_linenumber"), F.asc_nulls_first("source_id"), F.asc_nulls_first("title"), F.asc_nulls_first("company")]
    columns = ["source", "source_id", "title", "company", "fetched_at", "l_linenumber"]

    def same(rule, plain):
        wanted = sorted(map(str, plain(rows).select(columns).collect()))
        for limit in (dedup._BROADCAST, 0):
            monkeypatch.setattr(dedup, "_BROADCAST", limit)
            with scratch.kept_by(stored, rule) as got:
                assert sorted(map(str, got.select(columns).collect())) == wanted

    for given in (ties, None):
        for scope in ((), ("l_linenumber",)):
            monkeypatch.undo()
            same(dedup.bronze_rules(scope, given, with_keys), lambda df: dedup.dedup_bronze(df, scope, given))
    # One row without an id is alone with it, and goes all the same.
    norms = {"title_norm": F.lower("title"), "company_norm": F.lower("company")}
    rows = rows.where("source_id IS NOT NULL OR (l_linenumber = 0 AND source = 'muse')").withColumns(norms).dropDuplicates(columns)
    rows = rows.withColumn("job_id", F.when(F.col("title").isNotNull(), F.col("job_id")))
    rows.repartition(4).write.parquet(str(tmp_path / "s"))
    stored = lake.located(spark.read.parquet(str(tmp_path / "s")))
    monkeypatch.undo()
    same(dedup.staging_rules(ties), lambda df: dedup.staging(df, ties))
