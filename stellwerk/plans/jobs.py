"""The batch jobs: ingest, silver, gold, backfill."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from stellwerk.operators.dedup import bronze_rules
from stellwerk.operators.gold import default_calendar_end
from stellwerk.operators.quality import quality_report
from stellwerk.operators.silver import project_silver
from stellwerk.operators.skills import STANDARD_TAXONOMY, Skill
from stellwerk.operators.validate import checked, ingest_report, null_negative_salary, page_accounts, split_checked, without_taken_records
from stellwerk.plans import gold_upkeep
from stellwerk.plans.scratch import kept_by, written_once
from stellwerk.sources import lake
from stellwerk.sources.adapters import ADAPTERS
from stellwerk.sources.landing import read_landing
from stellwerk.sources.unify import filter_categories, parse_source_list, with_keys


BRONZE, QUARANTINE, PAGES = "bronze/postings", "bronze/quarantine", "bronze/pages"
SILVER, GOLD = "silver/postings", "gold"


def adapt(landing: Mapping[str, DataFrame], categories: Sequence[str] | None = None) -> DataFrame:
    """Landing records of several boards to keyed postings with ``reason`` and ``errors``.

    One pass over the records: valid and rejected rows come out of the same projection.
    """
    postings = [ADAPTERS[source](filter_categories(rows, categories)) for source, rows in landing.items()]
    return with_keys(null_negative_salary(checked(reduce(DataFrame.unionByName, postings))))


def store(
    rows: DataFrame, lake_root: str, run: str, run_day: dt.date | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Write checked postings to bronze and quarantine, and the accounts of the pages they came on."""
    valid, quarantine = split_checked(rows)
    if not valid.isEmpty():
        lake.write_bronze(valid, f"{lake_root}/{BRONZE}", run, run_day)
    lake.write_quarantine(quarantine, f"{lake_root}/{QUARANTINE}", run, run_day)
    lake.write_pages(page_accounts(rows), f"{lake_root}/{PAGES}", run)
    return valid, quarantine


def ingest(
    spark: SparkSession,
    landing_paths: Mapping[str, str],
    lake_root: str,
    run: str | None = None,
    run_day: dt.date | str | None = None,
    categories: Sequence[str] | None = None,
    enabled: str | None = None,
) -> DataFrame:
    """Landing files to bronze and quarantine; returns the run report, one row per board asked, silent ones included.

    ``enabled`` is a comma list of boards to take; None takes all that have a path.
    """
    wanted = parse_source_list(enabled)
    landing = {s: read_landing(spark, s, path, pages=True) for s, path in landing_paths.items() if s in wanted}
    if not landing:
        raise ValueError("none of the enabled boards has a landing path")
    run = run or uuid.uuid4().hex
    with written_once(without_taken_records(adapt(landing, categories)), "ingest") as rows:
        store(rows, lake_root, run, run_day)
    return ingest_report(lake.read_pages(spark, f"{lake_root}/{PAGES}", run), list(landing))


def refresh_silver(
    spark: SparkSession,
    lake_root: str,
    first: dt.date | str,
    last: dt.date | str | None = None,
    categories: Sequence[str] | None = None,
    taxonomy: Sequence[Skill] = STANDARD_TAXONOMY,
    days: Sequence[dt.date | str] | None = None,
) -> None:
    """Rebuild silver for a range of days in one job; each day is deduplicated on its own.

    A day of the range that has no bronze rows (any more) has no silver afterwards.
    """
    bronze = lake.read_bronze_days(spark, f"{lake_root}/{BRONZE}", first, last, categories, days)
    wanted = lake.days_between(first, last, days)
    with kept_by(bronze, bronze_rules(("run_day",), keys=with_keys)) as unique:
        lake.write_silver(project_silver(unique, taxonomy), f"{lake_root}/{SILVER}", wanted)


def refresh_gold(
    spark: SparkSession, lake_root: str, calendar_end: dt.date | str | None = None, full: bool = False
) -> dict[str, DataFrame]:
    """Bring the star schema in line with the silver days that changed since the last run (``gold_upkeep``).

    All tables change in one step. ``full`` builds them from all days.
    """
    end = default_calendar_end(dt.date.today()) if calendar_end is None else calendar_end
    return gold_upkeep.refresh(spark, f"{lake_root}/{SILVER}", f"{lake_root}/{GOLD}", end, full)


def run_day(
    spark: SparkSession,
    landing_paths: Mapping[str, str],
    lake_root: str,
    day: dt.date | str,
    taxonomy: Sequence[Skill] = STANDARD_TAXONOMY,
) -> tuple[DataFrame, DataFrame]:
    """One scheduled run: landing to gold; returns run report and quality report."""
    report = ingest(spark, landing_paths, lake_root, run_day=day)
    refresh_silver(spark, lake_root, day, taxonomy=taxonomy)
    gold = refresh_gold(spark, lake_root)
    return report, quality_report(gold, [s.canonical for s in taxonomy])


def backfill(
    spark: SparkSession,
    lake_root: str,
    first: dt.date | str,
    last: dt.date | str,
    taxonomy: Sequence[Skill] = STANDARD_TAXONOMY,
) -> dict[str, DataFrame]:
    """Rebuild the days ``first`` to ``last``, both included, then gold."""
    refresh_silver(spark, lake_root, first, last, taxonomy=taxonomy)
    return refresh_gold(spark, lake_root)
