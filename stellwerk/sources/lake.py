"""Lake layers: bronze, quarantine, silver and gold as partitioned files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stellwerk.functions.moments import day_literal
from stellwerk.operators.dedup import LOCATOR
from stellwerk.schemas import BRONZE, BRONZE_PARTITIONS, PAGES, QUARANTINE, SILVER
from stellwerk.sources import versions
from stellwerk.sources.unify import with_keys
from stellwerk.sources.versions import drop_folder, file_system  # noqa: F401

GOLD_TABLES = ["fact_jobs", "fact_skills", "dim_company", "dim_location", "dim_date"]


def _run_day(df: DataFrame, run_day: Column | dt.date | str | None) -> Column:
    """The given day, a ``run_day`` column or the fetch day."""
    if run_day is not None:
        return run_day if isinstance(run_day, Column) else day_literal(run_day)
    return F.col("run_day") if "run_day" in df.columns else F.to_date("fetched_at")


def _partition_columns(df: DataFrame, run_day: Column | dt.date | str | None, run: str) -> DataFrame:
    """source/year/month/day/category/run; the day is the given one, a ``run_day`` column or the fetch day."""
    day = _run_day(df, run_day)
    return df.withColumns(
        {
            "year": F.date_format(day, "yyyy"),
            "month": F.date_format(day, "MM"),
            "day": F.date_format(day, "dd"),
            # A slash would open a deeper directory.
            "category": F.regexp_replace("search_category", r"[/\\]", "_"),
            "run": F.lit(run),
        }
    )


def _balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Few, evenly sized files per partition: AQE splits a large partition over several tasks."""
    return df.hint("rebalance", *columns)


# Columns with few values in a folder first, so that neighbours in the shuffle differ in as little as possible.
_ALIKE = ["contract_type", "contract_time", "location_segments", "city", "search_category", "title"]


def _bronze_rows(df: DataFrame, run: str, run_day: dt.date | str | None) -> DataFrame:
    """Rows of the bronze layer, a folder's together.

    Keys and partition columns are made after the shuffle, of which they would be a quarter: hashes do not compress.
    Rows are sorted before it, as like rows side by side compress to two thirds. They are counted between the two
    because a sort right below a shuffle would be left out.
    """
    derived = ["job_id", "dedup_key", "source_priority", "year", "month", "day", "run"]
    rows = _partition_columns(df, run_day, run).withColumn("__day", _run_day(df, run_day))
    given = [c for c in BRONZE.fieldNames() if c not in derived]
    if missing := [c for c in given if c not in rows.columns]:
        raise ValueError(f"no postings to write: {', '.join(missing)} missing")
    alike = rows.select(*given, "__day").sortWithinPartitions(*_ALIKE)
    short = alike.observe("sorted", F.count(F.lit(1)).alias("rows"))
    balanced = with_keys(_balanced(short, "source", "__day", "category"))
    return _partition_columns(balanced, F.col("__day"), run).select(*BRONZE.fieldNames())


def write_bronze(df: DataFrame, root: str, run: str, run_day: dt.date | str | None = None) -> None:
    """Valid postings of one run; writing nothing is an error.

    The rows are counted as they are written, not looked for before.
    """
    written = Observation()
    (
        _bronze_rows(df, run, run_day)
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*BRONZE_PARTITIONS)
        .parquet(root)
    )
    if not written.get["rows"]:
        raise ValueError("no postings to write")


def write_quarantine(df: DataFrame, root: str, run: str, run_day: dt.date | str | None = None) -> bool:
    """Rejected records as JSON lines with their reason; False when there are none."""
    if df.isEmpty():
        return False
    rows = _partition_columns(df, run_day, run).select(*QUARANTINE.fieldNames())
    (
        _balanced(rows, *BRONZE_PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*BRONZE_PARTITIONS)
        .json(root)
    )
    return True


def write_pages(accounts: DataFrame, root: str, run: str) -> None:
    """Accounts of a run's pages; repeating the run replaces them."""
    rows = accounts.withColumn("run", F.lit(run)).select(*PAGES.fieldNames())
    (
        _balanced(rows)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(root)
    )


def read_pages(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    pages = spark.read.schema(PAGES).parquet(root)
    return pages if run is None else pages.where(F.col("run") == run)


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(QUARANTINE).json(root)


def partition_day() -> Column:
    """Run day of a bronze row, from partition columns only, so that filters on it prune directories."""
    return F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))


def read_bronze(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BRONZE).parquet(root)


def _day_folders(spark: SparkSession, root: str, days: Sequence[dt.date]) -> list[str]:
    """The boards' folders of the given days; only these are listed, however old the lake is."""
    path, system = file_system(spark, root)
    found = []
    for day in days:
        pattern = f"{root}/source=*/year={day:%Y}/month={day:%m}/day={day:%d}"
        found += [str(f.getPath()) for f in system.globStatus(path(pattern)) or []]
    return found


def located(df: DataFrame) -> DataFrame:
    """Add file and row position to rows that come straight from Parquet files."""
    file, row = LOCATOR
    return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def days_between(
    first: dt.date | str, last: dt.date | str | None = None, days: Sequence[dt.date | str] | None = None
) -> list[dt.date]:
    """The days ``first`` to ``last``, both included, or those of ``days`` among them."""
    low, high = (d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in (first, first if last is None else last))
    wanted = [low + dt.timedelta(n) for n in range((high - low).days + 1)]
    if days is not None:
        chosen = {d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in days}
        wanted = [d for d in wanted if d in chosen]
    return wanted


def read_bronze_days(
    spark: SparkSession,
    root: str,
    first: dt.date | str,
    last: dt.date | str | None = None,
    categories: Sequence[str] | None = None,
    days: Sequence[dt.date | str] | None = None,
) -> DataFrame:
    """Bronze of the days ``first`` to ``last`` (both included) over all boards, located, with ``run_day``.

    ``days`` names the wanted days inside that range one by one.
    """
    folders = _day_folders(spark, root, days_between(first, last, days))
    if folders:
        rows = located(spark.read.schema(BRONZE).option("basePath", root).parquet(*folders))
    else:
        rows = spark.createDataFrame([], located(read_bronze(spark, root)).schema)
    if categories:
        rows = rows.where(F.col("search_category").isin(list(categories)))
    return rows.withColumn("run_day", partition_day())


def read_bronze_day(
    spark: SparkSession, root: str, day: dt.date | str, categories: Sequence[str] | None = None
) -> DataFrame:
    return read_bronze_days(spark, root, day, day, categories)


def write_silver(df: DataFrame, root: str, days: Sequence[dt.date | str] | None = None) -> None:
    """Replace exactly the days that occur in ``df``; other days stay. Re-runs give the same result.

    ``days`` names the days that are meant: those of them without a row in ``df`` are emptied.
    """
    spark = df.sparkSession
    before = {} if days is None else silver_days(spark, root, days)
    (
        _balanced(df.select(*SILVER.fieldNames()), "run_day")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_day")
        .parquet(root)
    )
    # Written days have new files; a day whose files are the old ones got no row.
    for day, files in silver_days(spark, root, before).items() if before else ():
        if files == before[day]:
            drop_folder(spark, f"{root}/run_day={day}")


def silver_days(spark: SparkSession, root: str, days: Iterable[dt.date | str] | None = None) -> dict[str, int]:
    """The stored days (of those given), each with a fingerprint of its files, which changes with every write.

    Files are listed by Spark and their contents not read; one row for each day comes back.
    """
    path, system = file_system(spark, root)
    folders = [f"{root}/run_day=*"] if days is None else [f"{root}/run_day={day}" for day in days]
    folders = [f for f in folders if len(system.globStatus(path(f)) or [])]
    if not folders:
        return {}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
    day = F.regexp_extract("path", "/run_day=([^/]*)/[^/]*$", 1)
    sums = files.groupBy(day.alias("day")).agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("files"))
    return {row["day"]: row["files"] for row in sums.collect()}


def write_silver_day(df: DataFrame, root: str, day: dt.date | str) -> None:
    write_silver(df.withColumn("run_day", day_literal(day)), root)


def read_silver(spark: SparkSession, root: str, view: str | None = None) -> DataFrame:
    """All silver days under one schema, optionally registered as a view."""
    silver = spark.read.schema(SILVER).parquet(root)
    if view:
        silver.createOrReplaceTempView(view)
    return silver


def read_foreign_silver(spark: SparkSession, root: str) -> DataFrame:
    """Silver files of another writer: columns are merged by name."""
    return spark.read.option("mergeSchema", True).parquet(root)


def silver_day_exists(spark: SparkSession, root: str, day: dt.date | str) -> bool:
    """Does the day hold any row? Reads the partition of that day only, at most one row."""
    return not read_silver(spark, root).where(F.col("run_day") == day_literal(day)).isEmpty()


def write_gold(tables: Mapping[str, DataFrame], root: str) -> None:
    """Full refresh of the star schema: all tables change in one step, and a failed write changes none."""
    versions.write_version(next(iter(tables.values())).sparkSession, root, tables)


def read_gold(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The star schema of one version; readers keep it while the next one is written."""
    snapshot = versions.current(spark, root)
    if snapshot is None:
        raise FileNotFoundError(f"no gold tables below {root}")
    return {name: versions.read_table(spark, root, snapshot, name) for name in GOLD_TABLES}
