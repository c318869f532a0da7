"""Explicit schemas of every layer, and the fixed source dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The nine job boards, their priority when the same posting appears on several
# boards (higher wins) and the label shown for each.
SOURCES = [
    ("bundesagentur", 100, "Bundesagentur f. Arbeit"),
    ("adzuna", 90, "Adzuna"),
    ("arbeitnow", 85, "Arbeitnow"),
    ("jooble", 75, "Jooble"),
    ("jsearch", 65, "JSearch (RapidAPI)"),
    ("muse", 70, "The Muse"),
    ("remotive", 60, "Remotive"),
    ("jobicy", 50, "Jobicy"),
    ("remoteok", 45, "RemoteOK"),
]
SOURCE_NAMES = [name for name, _, _ in SOURCES]

# Words the data itself contains.
UNKNOWN = "unbekannt"
UNTITLED = "Unbekannt"
COUNTRY = "Deutschland"
REMOTE = "Remote"

# Activity states, weakest first.
SEEN, SAVED, APPLIED = "gesehen", "gespeichert", "beworben"

_POSTING_FIELDS = [
    T.StructField("source", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("location_segments", T.ArrayType(T.StringType())),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("salary_min", T.DoubleType()),
    T.StructField("salary_max", T.DoubleType()),
    T.StructField("salary_present", T.BooleanType()),
    T.StructField("currency", T.StringType()),
    T.StructField("contract_type", T.StringType()),
    T.StructField("contract_time", T.StringType()),
    T.StructField("category_tag", T.StringType()),
    T.StructField("category_label", T.StringType()),
    T.StructField("posted_at", T.TimestampType()),
    T.StructField("url", T.StringType()),
    T.StructField("search_category", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
]

PAGE_INFO = T.StructType(
    [
        T.StructField("hits", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("abort_reason", T.StringType()),
    ]
)

# What an adapter yields: the posting, the page it came from and its raw record, or the account of a page.
RAW = T.StructType(
    _POSTING_FIELDS
    + [
        T.StructField("page", T.IntegerType()),
        T.StructField("record", T.StringType()),
        T.StructField("intact", T.BooleanType()),
        T.StructField("page_info", PAGE_INFO),
    ]
)

# One row per board, search and page of a run.
PAGES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("search_category", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("pages", T.LongType()),
        T.StructField("hits", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("loaded", T.LongType()),
        T.StructField("valid", T.LongType()),
        T.StructField("abort_reason", T.StringType()),
        T.StructField("run", T.StringType()),
    ]
)

_KEY_FIELDS = [
    T.StructField("job_id", T.StringType()),
    T.StructField("dedup_key", T.StringType()),
    T.StructField("source_priority", T.IntegerType()),
]

# ``run`` is the last level: a run that is repeated replaces its own files and no others.
BRONZE_PARTITIONS = ["source", "year", "month", "day", "category", "run"]

# Partition columns stay text so that directories keep their zero-padded names (month=06).
BRONZE = T.StructType(
    [field for field in _POSTING_FIELDS if field.name != "source"]
    + _KEY_FIELDS
    + [T.StructField(name, T.StringType()) for name in BRONZE_PARTITIONS]
)

QUARANTINE = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("record", T.StringType()),
        T.StructField("search_category", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
    + [T.StructField(name, T.StringType()) for name in BRONZE_PARTITIONS]
)

SILVER = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("title_norm", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("company_norm", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("salary_min", T.DoubleType()),
        T.StructField("salary_max", T.DoubleType()),
        T.StructField("salary_mid", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("contract_time", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("posted_at", T.TimestampType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("dedup_key", T.StringType()),
        T.StructField("run_day", T.DateType()),
    ]
)

RUN_STATUS = T.StructType(
    [
        T.StructField("run_at", T.TimestampType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("loaded", T.LongType()),
        T.StructField("valid", T.LongType()),
        T.StructField("quarantined", T.LongType()),
        T.StructField("aborted", T.BooleanType()),
        T.StructField("abort_reason", T.StringType()),
        T.StructField(
            "quota",
            T.StructType(
                [
                    T.StructField("used", T.LongType()),
                    T.StructField("quota_limit", T.LongType()),
                    T.StructField("percent", T.DoubleType()),
                    T.StructField("monthly", T.BooleanType()),
                    T.StructField("reset_date", T.DateType()),
                ]
            ),
        ),
    ]
)

ACTIVITY = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("status", T.ArrayType(T.StringType())),
        T.StructField("snapshot", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def source_dimension(spark: SparkSession) -> DataFrame:
    """The nine boards as a DataFrame (name, priority, label)."""
    return spark.createDataFrame(SOURCES, "source string, source_priority int, label string")
