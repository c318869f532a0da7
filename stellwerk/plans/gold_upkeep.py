"""Gold kept up to date: a run deduplicates and rebuilds what its days can change, and nothing else.

Two small tables live beside gold, in the same versions (``sources.versions``), both without long texts:

``latest``      the latest observation of each job id over all days, in buckets by job id;
``candidates``  the same rows in buckets by title and company, each with a flag: does it win its title and company?

The fact tables lie in the buckets of their title and company; ``companies`` and ``places`` hold what each of these
buckets adds to the dimensions.

A run compares the files of the stored silver days with those the last version was built from, and takes the days that are new,
changed or gone:

1. Their rows meet the buckets of ``latest`` that they fall into. Where the latest observation of a posting lay in
   one of these days and is not there any more, the posting's other days are looked up; in all other cases the best of
   both sides is the latest over all days, because the old one was.
2. Postings whose latest observation changed are taken out of their old bucket of ``candidates`` and put into their new
   one; only these buckets choose winners again.
3. Facts of postings that won before and win now stay; the others are built from the rows of their own days.
4. The dimensions are summed from the buckets' shares.

One number decides for everything: a posting without a company points to the unknown company only if some posting carries a
blank one. If that changes, all facts are built anew, as in a first run.

A silver day holds each job id once, as ``bronze_to_silver`` makes it. Ties are settled by content, never by place in
a file, so that this and a build from all days give the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellwerk.functions.keys import company_key, filled_location
from stellwerk.operators import gold
from stellwerk.operators.dedup import LOCATOR, WIDE_COLUMNS, row_fingerprint, survivors
from stellwerk.plans.scratch import kept_by, written_once
from stellwerk.schemas import UNKNOWN
from stellwerk.sources import lake
from stellwerk.sources.versions import BUCKET, Change, bucket_of

BUCKETS = 64
_KEY = ["title_norm", "company_norm"]
_SHORT = ["job_id", "run_day", "fetched_at", "posted_at", "title", "company", *_KEY, "city", "state", "region", "short", "whole"]


def _order() -> list[Column]:
    return [
        F.desc_nulls_last("fetched_at"),
        F.desc_nulls_last("posted_at"),
        F.asc("title"),
        F.asc_nulls_first("company"),
        F.asc("short"),
        F.asc("whole"),
    ]


def _observations(silver: DataFrame) -> DataFrame:
    """The short columns of silver rows, and two hashes that settle ties and tell changes."""
    prints = {"short": row_fingerprint(silver, [*WIDE_COLUMNS, *LOCATOR]), "whole": row_fingerprint(silver, LOCATOR)}
    return silver.where(F.col("job_id").isNotNull()).withColumns(prints).select(*_SHORT)


def _key() -> list[Column]:
    return [F.col("title_norm"), company_key(F.col("company_norm"))]


def _by_job(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, bucket_of(buckets, "job_id"))


def _by_key(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, bucket_of(buckets, *_key()))


def _chosen(rows: DataFrame) -> DataFrame:
    """Mark the row that wins its title and company."""
    ranking = Window.partitionBy(*_key()).orderBy(*_order())
    return rows.withColumn("winner", F.row_number().over(ranking) == 1)


def _touched(*frames: DataFrame) -> list[int]:
    """Buckets that occur; at most as many rows as there are buckets."""
    return sorted({row[0] for df in frames for row in df.select(BUCKET).distinct().collect()})


@contextmanager
def _wide(silver: DataFrame, wanted: DataFrame, buckets: int) -> Iterator[DataFrame]:
    """Whole silver rows of the wanted postings, with their bucket; only the wanted rows' days are read.

    Ids and positions meet the wanted ones; the rows themselves are fetched by position and not shuffled.
    """
    days = [row.run_day for row in wanted.select("run_day").distinct().collect()]
    key = ["job_id", "run_day", BUCKET]

    def rule(rows: DataFrame) -> DataFrame:
        return _by_key(rows, buckets).join(wanted.select(*key).hint("shuffle_hash"), key, "left_semi")

    with kept_by(lake.located(silver).where(F.col("run_day").isin(days)), rule) as rows:
        yield _by_key(rows, buckets)


def _put_shares(change: Change, winners: DataFrame, touched: Iterable[int] | None) -> None:
    """What each bucket adds to the dimensions."""
    companies = winners.where(F.col("company").isNotNull()).groupBy(BUCKET, company_key(F.col("company_norm")).alias("company_norm"))
    change.put_buckets("companies", companies.agg(F.min("company").alias("company")), touched)
    place = filled_location(F.col("city"), F.col("state"), F.col("region"))
    places = winners.select(BUCKET, *[c.alias(n) for c, n in zip(place, ("city", "state", "region"))]).distinct()
    change.put_buckets("places", places, touched)


def _put_dimensions(change: Change, spark: SparkSession, end: dt.date | str) -> bool:
    """Dimensions from all buckets' shares; tells whether there is an unknown company."""
    change.put("dim_company", gold.build_dim_company(change.read("companies")))
    change.put("dim_location", gold.build_dim_location(change.read("places")))
    change.put("dim_date", gold.build_dim_date(spark, end))
    return not change.read("dim_company").where(F.col("company_norm") == UNKNOWN).isEmpty()


def _put_facts(change: Change, staging: DataFrame, old: dict[str, DataFrame], touched: Sequence[int] | None) -> None:
    """Facts of new winners, and those that stay."""
    built = {
        "fact_jobs": gold.build_fact_jobs(staging, change.read("dim_company"), [BUCKET]),
        "fact_skills": gold.build_fact_skills(staging, [BUCKET]),
    }
    for name, rows in built.items():
        change.put_buckets(name, rows.unionByName(old[name]) if name in old else rows, touched)


def _notes(days: dict[str, int], buckets: int, unknown: bool) -> dict:
    return {"days": days, "buckets": buckets, "unknown": unknown}


def _build(spark: SparkSession, silver_root: str, change: Change, end: dt.date | str, buckets: int) -> dict:
    """Everything from all silver days."""
    days = lake.silver_days(spark, silver_root)
    silver = lake.read_silver(spark, silver_root)
    latest = survivors(_observations(silver), ["job_id"], _order())
    change.put_buckets("latest", _by_job(latest, buckets))
    change.put_buckets("candidates", _chosen(_by_key(change.read("latest"), buckets)))
    winners = _by_key(change.read("candidates").where("winner"), buckets)
    _put_shares(change, winners, None)
    unknown = _put_dimensions(change, spark, end)
    with _wide(silver, winners, buckets) as staging:
        _put_facts(change, staging, {}, None)
    return _notes(days, buckets, unknown)


def _update(
    spark: SparkSession, silver_root: str, change: Change, end: dt.date | str, days: dict[str, int], buckets: int
) -> dict | None:
    """The same for the days that changed; None if the unknown company came or went."""
    known = change.base.notes["days"]
    changed = sorted(day for day in known.keys() | days.keys() if known.get(day) != days.get(day))
    if not changed:
        change.put("dim_date", gold.build_dim_date(spark, end))
        return change.base.notes
    today = [dt.date.fromisoformat(day) for day in changed]
    inside = F.col("run_day").isin(today)
    silver = lake.read_silver(spark, silver_root)
    with written_once(_by_job(_observations(silver.where(inside)), buckets), "observed") as observed:
        touched = set(_touched(observed))
        if set(changed) & known.keys():
            # Rows that these days have lost are known from here alone.
            touched |= set(_touched(_by_job(change.read("latest").where(inside), buckets)))
        touched = sorted(touched)
        old = _by_job(change.read("latest", touched), buckets)
        with written_once(_latest(spark, silver, old, observed, today, buckets), "latest") as now:
            same = old.join(now, ["job_id", "whole"], "left_semi").select("job_id")
            new = now.join(old, ["job_id", "whole"], "left_anti")
            seen = now.select("job_id").unionByName(old.where(inside).select("job_id")).distinct()
            gone = old.join(seen, "job_id", "left_semi").join(same, "job_id", "left_anti")
            with written_once(new, "came") as came, written_once(gone, "gone") as gone:
                stay = old.join(gone.select("job_id"), "job_id", "left_anti")
                change.put_buckets("latest", stay.unionByName(came), touched)
                return _replace(spark, silver, change, gone, came, end, days, buckets)


def _latest(
    spark: SparkSession, silver: DataFrame, old: DataFrame, observed: DataFrame, today: Sequence[dt.date], buckets: int
) -> DataFrame:
    """The latest observation of each posting that occurs in today's rows or whose latest one lay in today."""
    inside = F.col("run_day").isin(list(today))
    # An old row of today ranks behind an equal new one: only if it wins, its posting has lost its latest observation.
    pool = (
        old.where(~inside).withColumn("lost", F.lit(False))
        .unionByName(observed.withColumn("lost", F.lit(False)))
        .unionByName(old.where(inside).withColumn("lost", F.lit(True)))
    )
    best = survivors(pool, ["job_id"], [*_order(), F.asc("lost")])
    orphans = best.where("lost").select("job_id")
    found = best.where("NOT lost").drop("lost")
    if orphans.isEmpty():
        return found
    past = silver.where(~inside)
    days = [row.run_day for row in past.join(orphans, "job_id", "left_semi").select("run_day").distinct().collect()]
    rows = _observations(past.where(F.col("run_day").isin(days)).join(orphans, "job_id", "left_semi"))
    rows = rows.unionByName(observed.drop(BUCKET).join(orphans, "job_id", "left_semi"))
    return found.unionByName(_by_job(survivors(rows, ["job_id"], _order()), buckets))


def _replace(
    spark: SparkSession,
    silver: DataFrame,
    change: Change,
    gone: DataFrame,
    came: DataFrame,
    end: dt.date | str,
    days: dict[str, int],
    buckets: int,
) -> dict | None:
    """Candidates, shares and facts of the buckets that lost or got a posting."""
    gone, came = (_by_key(rows, buckets) for rows in (gone, came))
    touched = _touched(gone, came)
    before = change.read("candidates", touched)
    won = before.where("winner").select("job_id", "whole")
    stay = _by_key(before.drop("winner"), buckets).join(gone.select("job_id"), "job_id", "left_anti")
    change.put_buckets("candidates", _chosen(stay.unionByName(came)), touched)
    winners = _by_key(change.read("candidates", touched).where("winner"), buckets)
    _put_shares(change, winners, touched)
    unknown = _put_dimensions(change, spark, end)
    if unknown != change.base.notes["unknown"]:
        return None
    fresh = winners.join(won, ["job_id", "whole"], "left_anti")
    kept = winners.join(won, ["job_id", "whole"], "left_semi").select("job_id", BUCKET)
    old = {name: change.read(name, touched).join(kept.hint("shuffle_hash"), "job_id") for name in ("fact_jobs", "fact_skills")}
    with _wide(silver, fresh, buckets) as staging:
        _put_facts(change, staging, old, touched)
    return _notes(days, buckets, unknown)


def refresh(
    spark: SparkSession,
    silver_root: str,
    gold_root: str,
    calendar_end: dt.date | str,
    full: bool = False,
    buckets: int = BUCKETS,
) -> dict[str, DataFrame]:
    """Bring gold in line with the stored silver days; ``full`` builds everything anew, in ``buckets`` buckets.

    A first run is full. Returns the tables of the version that is in force afterwards.
    """
    change = Change(spark, gold_root)
    try:
        notes = None
        if not full and "days" in change.base.notes:
            days = lake.silver_days(spark, silver_root)
            notes = _update(spark, silver_root, change, calendar_end, days, change.base.notes["buckets"])
        if notes is None:
            change.abandon()
            change = Change(spark, gold_root)
            notes = _build(spark, silver_root, change, calendar_end, buckets)
        change.publish(notes)
    except Exception:
        change.abandon()
        raise
    return lake.read_gold(spark, gold_root)
