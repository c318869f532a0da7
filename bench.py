"""Benchmark: jobs and headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores. Bronze is written first,
then silver, staging and gold, each timed; the queries run on the stored gold tables, as they do in
service. Jobs are timed once, after a warm-up of the same chain on the smallest data set; every query
is run once to warm up and then timed as the best of three runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contract import fixtures as fx  # noqa: E402
from contract.landing_fixtures import landing  # noqa: E402
from stellwerk.operators import activity, dedup, metrics, quality, skills, visits  # noqa: E402
from stellwerk.operators.gold import build_gold  # noqa: E402
from stellwerk.operators.search import JobsFilter, search  # noqa: E402
from stellwerk.operators.silver import bronze_to_silver  # noqa: E402
from stellwerk.session import local_session  # noqa: E402
from stellwerk.sources import lake  # noqa: E402
from stellwerk.sources.adapters import ADAPTERS  # noqa: E402
from stellwerk.sources.visit_log import parse_visit_lines  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    root = tempfile.mkdtemp(prefix="stellwerk-bench-")
    times: dict[str, float] = {}

    def timed(name, action, runs=1):
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            result = action()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        return result

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # Warm-up: the whole chain once on the smallest data set, so that no job pays for class loading.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    run(fx.lazy_staged(spark, small if os.path.isdir(small) else sf_dir))

    # Jobs: each reads what the one before has written.
    timed("write_bronze", lambda: fx.bronze(spark, sf_dir).hint("rebalance").write.parquet(f"{root}/bronze"))
    bronze = spark.read.parquet(f"{root}/bronze")
    timed(
        "refresh_silver",
        lambda: bronze_to_silver(lake.located(bronze), fx.PART_LEXICON, ("run_day",), fx.ties()).write.parquet(
            f"{root}/silver"
        ),
    )
    silver = spark.read.parquet(f"{root}/silver")
    timed("build_staging", lambda: dedup.staging(lake.located(silver)).write.parquet(f"{root}/staging"))
    tables = build_gold(spark.read.parquet(f"{root}/staging"), fx.CALENDAR_END)
    timed("write_gold", lambda: lake.write_gold(tables, f"{root}/gold"))
    gold = lake.read_gold(spark, f"{root}/gold")

    names = [s.canonical for s in fx.PART_LEXICON]
    documents = fx.table(spark, sf_dir, "documents").hint("rebalance")
    fx.visit_lines(spark, sf_dir).hint("rebalance").write.text(f"{root}/visits")
    log = parse_visit_lines(spark.read.text(f"{root}/visits"))
    landing(spark, sf_dir, "adzuna").hint("rebalance").write.parquet(f"{root}/landing")
    records = spark.read.parquet(f"{root}/landing")

    queries = {
        "dedup_latest": lambda: dedup.dedup_latest(bronze, (), fx.ties()),
        "dedup_chain": lambda: dedup.dedup_bronze(bronze, ("run_day",), fx.ties()),
        "dedup_stored": lambda: dedup.dedup_stored_bronze(lake.located(bronze), ("run_day",), fx.ties()),
        "adapt_adzuna": lambda: ADAPTERS["adzuna"](records),
        "extract_skills": lambda: skills.with_skills(documents, "text").select("doc_id", "skills"),
        "search_page": lambda: search(gold, JobsFilter(search="ring", only_with_salary=True, limit=100)),
        "search_skills": lambda: search(gold, JobsFilter(skills=["Economy", "Widget"], only_remote=True)),
        "facets": lambda: metrics.all_facets(gold),
        "totals": lambda: metrics.totals(gold["fact_jobs"]),
        "top_skills": lambda: metrics.top_skills(gold["fact_skills"]),
        "top_companies": lambda: metrics.top_companies(gold),
        "top_cities": lambda: metrics.top_cities(gold),
        "jobs_per_day": lambda: metrics.new_jobs_per_day(gold["fact_jobs"], 365, fx.POSTINGS_AS_OF),
        "salary_distribution": lambda: metrics.salary_distribution(gold, "city"),
        "salary_distribution_exact": lambda: metrics.salary_distribution_exact(gold, "city"),
        "source_distribution": lambda: metrics.source_distribution(gold["fact_jobs"]),
        "quality_report": lambda: quality.quality_report(gold, names),
        "visits_top": lambda: visits.visits_top(log),
        "visit_totals": lambda: visits.visit_totals(log, fx.AS_OF),
        "activity_actions": lambda: activity.apply_actions(fx.actions(spark, sf_dir)),
    }
    for name, query in queries.items():
        run(query())
        timed(name, lambda query=query: run(query()), runs=3)

    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "total_time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
