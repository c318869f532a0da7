"""Facets, totals, rankings, time series and salary distributions over the gold tables.

Counts over a dimension attribute are first aggregated by foreign key, then joined: the join sees
one row per dimension entry instead of one per posting, whatever the skew.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.moments import trailing_start
from stellwerk.functions.text import blank_to_null
from stellwerk.schemas import UNKNOWN

Gold = Mapping[str, DataFrame]

FACET_LIMIT = 50
DISTRIBUTION_LIMIT = 25
QUARTILES = (0.25, 0.5, 0.75)
DISTRIBUTION_GROUPS = ("category", "city", "state", "source")


# ---- facets ------------------------------------------------------------------------------------


def facet_values(jobs: DataFrame, column: str, keep_blank: bool = False) -> DataFrame:
    """Distinct values of a fact column, ascending."""
    value = F.col(column) if keep_blank else blank_to_null(F.col(column))
    return jobs.select(value.alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def _named_place(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin("", UNKNOWN)


def facet_states(dim_location: DataFrame) -> DataFrame:
    return (
        dim_location.where(_named_place("state")).select(F.col("state").alias("value")).distinct().orderBy("value")
    )


def _postings_per_place(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("location_id").agg(
        F.count("*").alias("n"), F.sum("salary_mid").alias("mid_sum"), F.count("salary_mid").alias("mid_n")
    )


def _top_values(counts: DataFrame, limit: int | None) -> DataFrame:
    ranked = counts.orderBy(F.desc("n"), F.asc("value"))
    return ranked if limit is None else ranked.limit(limit)


def facet_top_cities(gold: Gold, limit: int = FACET_LIMIT) -> DataFrame:
    counts = (
        _postings_per_place(gold["fact_jobs"])
        .join(gold["dim_location"].where(_named_place("city")), "location_id")
        .groupBy(F.col("city").alias("value"))
        .agg(F.sum("n").alias("n"))
    )
    return _top_values(counts, limit)


def facet_top_skills(fact_skills: DataFrame, limit: int = FACET_LIMIT) -> DataFrame:
    return _top_values(fact_skills.groupBy(F.col("skill").alias("value")).agg(F.count("*").alias("n")), limit)


def facet_sources(jobs: DataFrame) -> DataFrame:
    counts = (
        jobs.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"))
    )
    return _top_values(counts, None)


def all_facets(gold: Gold, limit: int = FACET_LIMIT) -> DataFrame:
    """Every facet as (facet, value, n); n is NULL where a facet has no count."""
    jobs = gold["fact_jobs"]

    # The three value facets come out of one scan: unpivot, then one distinct.
    triple = F.array(
        F.struct(F.lit("categories").alias("facet"), F.col("category").alias("value")),
        F.struct(F.lit("contract_types").alias("facet"), blank_to_null(F.col("contract_type")).alias("value")),
        F.struct(F.lit("contract_times").alias("facet"), blank_to_null(F.col("contract_time")).alias("value")),
    )
    values = jobs.select(F.inline(triple)).where(F.col("value").isNotNull()).distinct()

    no_count = F.lit(None).cast("bigint").alias("n")
    parts = [
        values.select("facet", "value", no_count),
        facet_states(gold["dim_location"]).select(F.lit("states").alias("facet"), "value", no_count),
        facet_top_cities(gold, limit).select(F.lit("cities").alias("facet"), "value", "n"),
        facet_top_skills(gold["fact_skills"], limit).select(F.lit("skills").alias("facet"), "value", "n"),
        facet_sources(jobs).select(F.lit("sources").alias("facet"), "value", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- totals and rankings -----------------------------------------------------------------------


def totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("jobs"),
        F.count_distinct("company_id").alias("companies"),
        F.count_distinct("location_id").alias("locations"),
        F.count_distinct("source").alias("sources"),
        F.avg("salary_mid").alias("salary_mid"),
        F.min("posted_at").alias("first_posted_at"),
        F.max("posted_at").alias("last_posted_at"),
    )


def _window_of(df: DataFrame, limit: int, offset: int) -> DataFrame:
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def top_skills(fact_skills: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Skills by mentions. Each posting holds a skill once, so postings per skill is a plain count."""
    counts = fact_skills.groupBy("skill").agg(F.count("*").alias("n"), F.count("job_id").alias("jobs"))
    return _window_of(counts.orderBy(F.desc("n"), F.asc("skill")), limit, offset)


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.col(total), F.col(n))


def top_companies(gold: Gold, limit: int = 20, offset: int = 0) -> DataFrame:
    """Companies by postings. A company name belongs to exactly one key, so one aggregate is enough."""
    per_company = (
        gold["fact_jobs"]
        .where(F.col("company_id").isNotNull())
        .groupBy("company_id")
        .agg(F.count("*").alias("jobs"), F.avg("salary_mid").alias("salary_mid"))
    )
    named = per_company.join(gold["dim_company"].where(F.col("company").isNotNull()), "company_id")
    ranked = named.select("company", "jobs", "salary_mid").orderBy(F.desc("jobs"), F.asc("company"))
    return _window_of(ranked, limit, offset)


def top_cities(gold: Gold, limit: int = 20, offset: int = 0) -> DataFrame:
    per_city = (
        _postings_per_place(gold["fact_jobs"])
        .join(gold["dim_location"].where(F.col("city").isNotNull()), "location_id")
        .groupBy("city", "state")
        .agg(F.sum("n").alias("jobs"), F.sum("mid_sum").alias("mid_sum"), F.sum("mid_n").alias("mid_n"))
    )
    ranked = per_city.select("city", "state", "jobs", _mean("mid_sum", "mid_n").alias("salary_mid")).orderBy(
        F.desc("jobs"), F.asc("city"), F.asc("state")
    )
    return _window_of(ranked, limit, offset)


def source_distribution(jobs: DataFrame) -> DataFrame:
    return (
        jobs.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count("*").alias("jobs"), F.avg("salary_mid").alias("salary_mid"))
        .orderBy(F.desc("jobs"), F.asc("source"))
    )


def filter_ranking(ranking: DataFrame, name_col: str, text: str) -> DataFrame:
    """Rows of a ranking whose name contains the text, ignoring case; no text keeps all."""
    return ranking.where(F.lower(name_col).contains(text.lower())) if text else ranking


def new_jobs_per_day(jobs: DataFrame, days: int, as_of: dt.date | str) -> DataFrame:
    """Postings per day since ``days`` before ``as_of``; days without postings do not appear."""
    since = trailing_start(as_of, days).cast(jobs.schema["posted_at"].dataType)
    return (
        jobs.where(F.col("posted_at") >= since)
        .groupBy(F.to_date("posted_at").alias("day"))
        .agg(F.count("*").alias("n"))
        .orderBy("day")
    )


# ---- salary distribution -----------------------------------------------------------------------


PLACE_GROUPS = ("city", "state")
# Rank error of a KLL sketch, constant / k ** power, at 99 %.
_KLL_CONSTANT, _KLL_POWER = 2.296, 0.9021


def _salaries(gold: Gold, group: str) -> DataFrame:
    """(grp, salary_mid) of every posting that has both; ``group`` is a column of the facts."""
    if group not in DISTRIBUTION_GROUPS:
        raise ValueError(f"group must be one of {DISTRIBUTION_GROUPS}, not {group!r}")
    jobs = gold["fact_jobs"].where(F.col("salary_mid").isNotNull())
    # Empty names still count for the cut to the largest groups; _top_groups drops them after it.
    return jobs.select(F.col(group).alias("grp"), "salary_mid").where(F.col("grp").isNotNull())


def _value_counts(gold: Gold, group: str) -> DataFrame:
    """``grp, v, c``: how often each salary occurs in a group. Counted per foreign key before places are joined."""
    if group not in PLACE_GROUPS:
        salaries = _salaries(gold, group)
        return salaries.groupBy("grp", F.col("salary_mid").alias("v")).agg(F.count("*").alias("c"))
    jobs = gold["fact_jobs"].where(F.col("salary_mid").isNotNull())
    counts = jobs.groupBy("location_id", F.col("salary_mid").alias("v")).agg(F.count("*").alias("c"))
    places = gold["dim_location"].select("location_id", F.col(group).alias("grp")).where(F.col("grp").isNotNull())
    return counts.join(places, "location_id").groupBy("grp", "v").agg(F.sum("c").alias("c"))


def _top_groups(stats: DataFrame, limit: int | None) -> DataFrame:
    top = stats.orderBy(F.desc("n"), F.asc("grp"))
    top = top if limit is None else top.limit(limit)
    return top.where(F.col("grp") != "").orderBy(F.desc("n"), F.asc("grp"))


def salary_distribution(
    gold: Gold, group: str = "category", accuracy: int = 10_000, limit: int | None = DISTRIBUTION_LIMIT
) -> DataFrame:
    """Quartiles per group from mergeable sketches: bounded memory per group, one shuffle of sketches.

    The rank error is at most n / accuracy. For places, see ``place_sketches``.
    """
    if group in PLACE_GROUPS:
        return _top_groups(_place_quartiles(gold, place_sketches(gold["fact_jobs"], accuracy), group), limit)
    stats = (
        _salaries(gold, group)
        .groupBy("grp")
        .agg(
            F.count("*").alias("n"),
            F.percentile_approx("salary_mid", list(QUARTILES), accuracy).alias("q"),
            F.avg("salary_mid").alias("salary_mid"),
        )
        .select(
            "grp",
            "n",
            F.get("q", 0).alias("salary_p25"),
            F.get("q", 1).alias("salary_median"),
            F.get("q", 2).alias("salary_p75"),
            "salary_mid",
        )
    )
    return _top_groups(stats, limit)


def place_sketches(jobs: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """``location_id, n, total, sketch``: salaries of each place key, to be stored or merged into any grouping of places.

    KLL sketches hold up to ``k`` values exactly; beyond, the rank error is about n / accuracy with a probability of
    99 % (k cannot exceed 65,535, which stands for an accuracy of 9,600).
    """
    k = min(max(8, math.ceil((_KLL_CONSTANT * accuracy) ** (1 / _KLL_POWER))), 65_535)
    return jobs.where(F.col("salary_mid").isNotNull()).groupBy("location_id").agg(
        F.count("*").alias("n"),
        F.sum("salary_mid").alias("total"),
        F.kll_sketch_agg_double("salary_mid", F.lit(k)).alias("sketch"),
    )


def _place_quartiles(gold: Gold, sketches: DataFrame, group: str) -> DataFrame:
    """Sketches merged by a column of the place dimension: the join sees one row per place key."""
    places = gold["dim_location"].select("location_id", F.col(group).alias("grp")).where(F.col("grp").isNotNull())
    merged = sketches.join(places, "location_id").groupBy("grp").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    quartiles = zip(("salary_p25", "salary_median", "salary_p75"), QUARTILES)
    return merged.select(
        "grp",
        "n",
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in quartiles],
        (F.col("total") / F.col("n")).alias("salary_mid"),
    )


def exact_quantiles(
    df: DataFrame, group: str, value: str, quantiles: Sequence[float] = QUARTILES, width: float = 100.0
) -> DataFrame:
    """Exact interpolated quantiles per group as an array ``q`` plus the group's row count ``n``.

    Equal values collapse into counts before the first shuffle.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(group).alias("grp"), F.col(value).alias("v"))
        .agg(F.count("*").alias("c"))
    )
    return quantiles_of_counts(counts, quantiles, width)


def quantiles_of_counts(
    counts: DataFrame, quantiles: Sequence[float] = QUARTILES, width: float = 100.0
) -> DataFrame:
    """The same from ``grp, v, c``: how often each value occurs in a group.

    The counts are summed per value band of the given width; running totals over bands tell which bands
    hold the wanted ranks, and only those bands are ranked value by value. No task ever sees a whole group, only one
    band of it.
    """
    counts = counts.withColumn("band", F.floor(F.col("v") / F.lit(float(width))))
    by_band = Window.partitionBy("grp").orderBy("band")
    bands = (
        counts.groupBy("grp", "band")
        .agg(F.sum("c").alias("c"))
        .withColumn("upto", F.sum("c").over(by_band.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("n", F.sum("c").over(Window.partitionBy("grp")))
    )
    # Quantile i of n values lies between the 0-based ranks floor(p) and ceil(p) with p = q (n - 1).
    wanted = bands.select(
        "grp",
        "band",
        "n",
        (F.col("upto") - F.col("c")).alias("before"),
        "upto",
        F.posexplode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("i", "p"),
    ).withColumn("pos", F.col("p") * (F.col("n") - 1))
    edges = wanted.select(
        "*", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("rank")
    ).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))

    hit_bands = edges.select("grp", "band", "before").distinct()
    by_value = Window.partitionBy("grp", "band").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.join(hit_bands, ["grp", "band"])
        .withColumn("last", F.col("before") + F.sum("c").over(by_value))
        .select("grp", "band", "v", (F.col("last") - F.col("c")).alias("first"), "last")
    )
    picked = edges.join(ranked, ["grp", "band"]).where(
        (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    )
    per_quantile = (
        picked.groupBy("grp", "i", "n", "pos")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"))
        .withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * (F.col("pos") - F.floor("pos")))
    )
    # One row per quantile and group: the list has as many entries as quantiles were asked for.
    return per_quantile.groupBy("grp", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q")
    )


def salary_distribution_exact(
    gold: Gold, group: str = "category", limit: int | None = DISTRIBUTION_LIMIT
) -> DataFrame:
    """The same table with exact interpolated quartiles, from value counts that also give the means: one scan of the facts."""
    counts = _value_counts(gold, group)
    means = counts.groupBy("grp").agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("salary_mid"))
    stats = (
        quantiles_of_counts(counts)
        .join(means, "grp")
        .select(
            "grp",
            "n",
            F.get("q", 0).alias("salary_p25"),
            F.get("q", 1).alias("salary_median"),
            F.get("q", 2).alias("salary_p75"),
            "salary_mid",
        )
    )
    return _top_groups(stats, limit)


def salary_spread(distribution: DataFrame) -> DataFrame:
    """Median, lower quartile and interquartile range for the chart; missing counts as 0."""
    p25 = F.coalesce("salary_p25", F.lit(0.0))
    p75 = F.coalesce("salary_p75", F.lit(0.0))
    return distribution.select(
        "grp",
        F.coalesce("salary_median", F.lit(0.0)).alias("median"),
        F.greatest(F.lit(0.0), p75 - p25).alias("spread"),
        p25.alias("p25"),
    )
