"""Visit-log statistics. Times are Berlin local text ``yyyy-MM-dd HH:mm:ss zone``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.moments import day_literal, month_start

# Requests that are no page views.
IGNORED_PATHS = ["/api/v1/health", "/api/v1/ready"]
IGNORED_PREFIXES = ["/_next/", "/favicon", "/static/", "/__nextjs"]

# Device classes and the words that reveal them; the first hit counts.
DEVICE_RULES = [
    ("Bot/Crawler", ["googlebot", "bingbot", "bot/", "crawler"]),
    ("Mobile", ["mobile", "android", "iphone"]),
    ("Windows", ["windows"]),
    ("macOS", ["macintosh", "mac os"]),
    ("Linux", ["linux"]),
]
DEVICE_OTHER, DEVICE_UNKNOWN, DIRECT = "Sonstige", "Unbekannt", "Direkt"

DEFAULT_TOP_N = 10
TOP_N = {"status": 20}


def visit_day(time: Column) -> Column:
    return F.left(time, F.lit(10)).try_cast("date")


def geo_part(geo: Column, position: int) -> Column:
    """Country (0), city (1) or provider (2); ? when the part is missing."""
    return F.coalesce(F.trim(F.get(F.split(geo, r"\|"), position)), F.lit("?"))


def strip_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def referrer_domain(referrer: Column) -> Column:
    """Host of the referrer without www.; text that is no URL stays as it is."""
    authority = F.regexp_extract(referrer, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.when(authority != "", authority).otherwise(referrer)
    missing = F.coalesce(referrer, F.lit("")).isin("", "-")
    return F.when(missing, F.lit(DIRECT)).otherwise(F.replace(host, F.lit("www."), F.lit("")))


def device_class(ua: Column) -> Column:
    text = F.lower(ua)
    classes = F.when(F.coalesce(ua, F.lit("")).isin("", "-"), F.lit(DEVICE_UNKNOWN))
    for name, words in DEVICE_RULES:
        classes = classes.when(reduce(or_, [text.contains(w) for w in words]), F.lit(name))
    return classes.otherwise(F.lit(DEVICE_OTHER))


def exclude_paths(visits: DataFrame) -> DataFrame:
    """Drop health checks and static files."""
    path = F.col("path")
    ignored = reduce(or_, [path.startswith(p) for p in IGNORED_PREFIXES], path.isin(IGNORED_PATHS))
    return visits.where(~ignored)


def visit_totals(visits: DataFrame, as_of: dt.date | str) -> DataFrame:
    """All visits, distinct addresses, and visits today, in the last 7 days and this month."""
    day, today = visit_day(F.col("time")), day_literal(as_of)
    return visits.select("ip", day.alias("day")).agg(
        F.count("*").alias("visits"),
        F.count_distinct("ip").alias("distinct_ips"),
        F.count_if(F.col("day") == today).alias("today"),
        F.count_if(F.col("day").between(F.date_sub(today, 6), today)).alias("last_7_days"),
        F.count_if(F.trunc("day", "MM") == month_start(as_of)).alias("this_month"),
    )


def visits_per_day(visits: DataFrame, as_of: dt.date | str, days: int = 30) -> DataFrame:
    """Visits on each of the last ``days`` days; days without visits count 0."""
    today = day_literal(as_of)
    first = F.date_sub(today, days - 1)
    calendar = visits.sparkSession.range(1).select(F.explode(F.sequence(first, today)).alias("day"))
    counts = (
        visits.select(visit_day(F.col("time")).alias("day"))
        .where(F.col("day").between(first, today))
        .groupBy("day")
        .agg(F.count("*").alias("n"))
    )
    return calendar.join(counts, "day", "left").fillna(0, ["n"]).orderBy("day")


def visits_top(visits: DataFrame, n: int = DEFAULT_TOP_N, per_dimension: Mapping[str, int] = TOP_N) -> DataFrame:
    """Most frequent countries, cities, providers, paths, referrers, status codes and devices.

    ``per_dimension`` sets another length than ``n`` for some. All seven rankings come from one scan and one shuffle of counts.
    """
    geo = F.col("geo")
    dimensions = {
        "country": geo_part(geo, 0),
        "city": geo_part(geo, 1),
        "isp": geo_part(geo, 2),
        "path": strip_query(F.col("path")),
        "referrer": referrer_domain(F.col("referrer")),
        "status": F.col("status"),
        "device": device_class(F.col("ua")),
    }
    unpivoted = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("name")) for d, v in dimensions.items()])
    counts = visits.select(F.inline(unpivoted)).groupBy("dimension", "name").agg(F.count("*").alias("n"))
    limits = F.lit(n)
    for dimension, own in per_dimension.items():
        limits = F.when(F.col("dimension") == dimension, F.lit(own)).otherwise(limits)
    ranking = Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("name"))
    # The constant bound lets Spark cut each map task's rows before the shuffle.
    return (
        counts.withColumn("rank", F.row_number().over(ranking))
        .where(F.col("rank") <= max([n, *per_dimension.values()]))
        .where(F.col("rank") <= limits)
    )


def search_visits(visits: DataFrame, text: str) -> DataFrame:
    """Visits that mention the text in any field; blank text keeps all."""
    wanted = text.strip().lower()
    if not wanted:
        return visits
    exact = [F.col(c).contains(wanted) for c in ("ip", "status")]
    folded = [F.lower(c).contains(wanted) for c in ("geo", "path", "ua", "referrer")]
    return visits.where(reduce(or_, exact + folded))


def visits_newest_first(visits: DataFrame) -> DataFrame:
    return visits.orderBy(F.desc("time"))
