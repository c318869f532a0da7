"""Posting search: predicates, skill filter, page order, keyset paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.functions.text import like_anywhere
from stellwerk.schemas import REMOTE, SEEN

PAGE_COLUMNS = [
    "job_id",
    "source",
    "source_id",
    "title",
    "company",
    "city",
    "state",
    "salary_min",
    "salary_max",
    "salary_mid",
    "currency",
    "contract_type",
    "contract_time",
    "posted_at",
    "category",
    "skills",
    "url",
]
MAX_PAGE = 200


@dataclass
class JobsFilter:
    """Everything a search can ask for; unset fields do not filter."""

    search: str | None = None
    city: str | None = None
    state: str | None = None
    company: str | None = None
    category: str | None = None
    contract_type: str | None = None
    contract_time: str | None = None
    currency: str | None = None
    salary_min: float | None = None
    salary_max: float | None = None
    only_with_salary: bool = False
    only_remote: bool = False
    posted_since: str | None = None
    posted_until: str | None = None
    skills: Sequence[str] = field(default_factory=list)
    sources: Sequence[str] = field(default_factory=list)
    after: str | None = None
    limit: int = 25


def _equal_lower(column: str, wanted: str) -> Column:
    return F.lower(column) == wanted.lower()


def salary_at_least(amount: float) -> Column:
    return F.coalesce("salary_mid", "salary_max") >= float(amount)


def salary_at_most(amount: float) -> Column:
    return F.coalesce("salary_mid", "salary_min") <= float(amount)


def parse_keyset(token: str) -> tuple[str, str]:
    """Split ``<iso8601>|<job id>``; a blank stands for a plus sign lost in a URL."""
    moment, bar, job = token.partition("|")
    if not bar:
        raise ValueError("keyset must look like <iso8601>|<id>")
    return moment.replace(" ", "+"), job


def after_keyset(token: str, moment_type: str = "timestamp") -> Column:
    """Rows after the token in page order; rows without a date only ever appear on the first page."""
    moment, job = parse_keyset(token)
    at = F.lit(moment).cast(moment_type)
    posted = F.col("posted_at")
    return (posted < at) | ((posted == at) & (F.col("job_id") < job))


def fact_predicates(f: JobsFilter, moment_type: str = "timestamp") -> list[Column]:
    """Predicates that need the fact table alone, hence reach its scan."""
    found: list[Column] = []
    if f.category:
        found.append(_equal_lower("category", f.category))
    if f.contract_type:
        found.append(_equal_lower("contract_type", f.contract_type))
    if f.contract_time:
        found.append(_equal_lower("contract_time", f.contract_time))
    if f.currency:
        found.append(F.upper("currency") == f.currency.upper())
    if f.salary_min is not None:
        found.append(salary_at_least(f.salary_min))
    if f.salary_max is not None:
        found.append(salary_at_most(f.salary_max))
    if f.only_with_salary:
        found.append(F.col("salary_mid").isNotNull())
    if f.posted_since:
        found.append(F.col("posted_at") >= F.lit(f.posted_since).cast(moment_type))
    if f.posted_until:
        found.append(F.col("posted_at") <= F.lit(f.posted_until).cast(moment_type))
    if f.sources:
        found.append(F.lower("source").isin([s.lower() for s in f.sources]))
    if f.after:
        found.append(after_keyset(f.after, moment_type))
    return found


def location_predicates(f: JobsFilter) -> list[Column]:
    found: list[Column] = []
    if f.city:
        found.append(like_anywhere(F.col("city"), f.city))
    if f.state:
        found.append(_equal_lower("state", f.state))
    if f.only_remote:
        found.append(F.col("region") == REMOTE)
    return found


def having_all_skills(jobs: DataFrame, fact_skills: DataFrame, skills: Sequence[str]) -> DataFrame:
    """Postings with every wanted skill: one semi join however many skills are asked for.

    Each posting holds a skill once, so counting rows per posting is enough.
    """
    wanted = list(dict.fromkeys(skills))
    hits = fact_skills.where(F.col("skill").isin(wanted)).select("job_id", "skill")
    if len(wanted) > 1:
        hits = hits.groupBy("job_id").agg(F.count("skill").alias("n")).where(F.col("n") == len(wanted))
    return jobs.join(hits.select("job_id"), "job_id", "left_semi")


def matching_jobs(gold: Mapping[str, DataFrame], f: JobsFilter) -> DataFrame:
    """Fact rows that satisfy the whole filter.

    Dimension predicates filter the dimension first and reach the fact as a semi join; Spark
    broadcasts the surviving keys when their measured size allows it.
    """
    jobs = gold["fact_jobs"]
    moment_type = jobs.schema["posted_at"].dataType.simpleString()
    predicates = fact_predicates(f, moment_type)
    if predicates:
        jobs = jobs.where(reduce(and_, predicates))
    places = location_predicates(f)
    if places:
        keys = gold["dim_location"].where(reduce(and_, places)).select("location_id")
        jobs = jobs.join(keys, "location_id", "left_semi")
    companies = gold["dim_company"]
    if f.company:
        keys = companies.where(like_anywhere(F.col("company_norm"), f.company)).select("company_id")
        jobs = jobs.join(keys, "company_id", "left_semi")
    if f.search:
        # Titles are tested at the scan; only postings whose title does not match go to the company join.
        named = companies.where(like_anywhere(F.col("company_norm"), f.search)).select("company_id")
        by_title = F.coalesce(like_anywhere(F.col("title"), f.search), F.lit(False))
        jobs = jobs.where(by_title).unionByName(jobs.where(~by_title).join(named, "company_id", "left_semi").select(*jobs.columns))
    if f.skills:
        jobs = having_all_skills(jobs, gold["fact_skills"], f.skills)
    return jobs


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}, not {limit}")
    return limit


def search(gold: Mapping[str, DataFrame], f: JobsFilter) -> DataFrame:
    """One page of postings with company and place.

    The page is cut from the fact table before the dimensions are joined, so the joins see at most
    200 fact rows.
    """
    order = [F.desc_nulls_last("posted_at"), F.desc("job_id")]
    page = matching_jobs(gold, f).orderBy(*order).limit(checked_limit(f.limit))
    return (
        page.join(gold["dim_company"].select("company_id", "company"), "company_id", "left")
        .join(gold["dim_location"].select("location_id", "city", "state"), "location_id", "left")
        .select(*PAGE_COLUMNS)
        .orderBy(*order)
    )


def next_keyset(page: DataFrame, limit: int) -> str | None:
    """Token for the following page, or None when this page is not full or ends without a date.

    One row reaches the driver: the page's length and its last posting.
    """
    moment = F.coalesce(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
    end = page.agg(F.count("*").alias("n"), F.min(F.struct(moment.alias("moment"), F.col("job_id"))).alias("last")).first()
    if end.n != checked_limit(limit) or not end.last.moment:
        return None
    return f"{end.last.moment}|{end.last.job_id}"


def unseen_only(jobs: DataFrame, activity: DataFrame, username: str | None = None) -> DataFrame:
    """Hide postings a user has seen already."""
    if username is not None:
        activity = activity.where(F.col("username") == username)
    seen = activity.where(F.array_contains("status", SEEN)).select("job_id")
    return jobs.join(seen, "job_id", "left_anti")
