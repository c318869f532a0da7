"""Landing zone: responses of the job boards as they were fetched.

One JSON line per response: ``{"search_category", "page", "fetched_at", "body": <response>}``. Lines
keep files large and splittable. The postings inside a response stay raw JSON text, so a broken
posting costs itself only and never its page. A fetch that had to stop leaves a line with ``abort_reason``
and no body.

Pages can be accounted for in the same pass: with ``pages``, every line yields, before its postings, a row without a record whose
``page_info`` holds the number of postings, the board's own estimate of the total, and the reason of an abort. So pages
without postings, and boards that answer nothing else, are still seen after the postings are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.functions.moments import parse_iso
from stellwerk.functions.text import is_json_object

# Where each board puts the postings in its response; '' is a bare array.
ENVELOPES = {
    "adzuna": "results",
    "bundesagentur": "stellenangebote",
    "jooble": "jobs",
    "arbeitnow": "data",
    "jsearch": "data.jobs",
    "muse": "results",
    "remotive": "jobs",
    "jobicy": "jobs",
    "remoteok": "",
}

# Where a board puts its estimate of all postings of the search, and how many postings one of that unit is. Boards
# not listed answer everything on one page.
TOTALS = {
    "adzuna": ("count", 1),
    "bundesagentur": ("maxErgebnisse", 1),
    "arbeitnow": ("meta.total", 1),
    "jooble": ("totalCount", 1),
    "muse": ("page_count", 20),
}


def _nested(path: str, kind: str) -> str:
    for name in reversed(path.split(".")):
        kind = f"struct<`{name}`: {kind}>"
    return kind


def body_type(source: str) -> str:
    """Type of a response: nested structs down to an array of raw JSON texts, and the total beside it."""
    if not ENVELOPES[source]:
        return "array<string>"
    wanted = _nested(ENVELOPES[source], "array<string>")
    if source not in TOTALS:
        return wanted
    # The total never lies inside the struct of the postings.
    return f"{wanted[:-1]}, {_nested(TOTALS[source][0], 'string')[len('struct<'):]}"


def line_schema(source: str) -> str:
    return (
        f"search_category string, page string, fetched_at string, abort_reason string, "
        f"body {body_type(source)}, _corrupt_record string"
    )


def _below_body(path: str) -> Column:
    return F.col("body" + "".join(f".`{p}`" for p in path.split(".") if p))


def _page_info(source: str, postings: Column) -> Column:
    """Postings on the page, estimated postings of the whole search, reason of an abort."""
    hits = F.coalesce(F.size(postings), F.lit(0)).cast("bigint")
    total = hits
    if source in TOTALS:
        path, unit = TOTALS[source]
        total = _below_body(path).try_cast("bigint") * unit
    return F.struct(hits.alias("hits"), F.when(postings.isNotNull(), total).alias("total"), F.col("abort_reason"))


def records(lines: DataFrame, source: str, pages: bool = False) -> DataFrame:
    """One row per posting of the response lines; a broken line becomes one record of its own.

    ``intact`` tells whether the record is a well-formed JSON object. With ``pages`` there is one row more per page, with
    ``page_info`` and no record.
    """
    postings = _below_body(ENVELOPES[source])
    broken = F.col("_corrupt_record").isNotNull()
    info = _page_info(source, postings)
    none, no_record = F.lit(None).cast("struct<hits: bigint, total: bigint, abort_reason: string>"), F.lit(None).cast("string")
    entry = lambda record, info: F.struct(record.alias("record"), info.alias("page_info"))
    taken = F.transform(F.coalesce(postings, F.array().cast("array<string>")), lambda record: entry(record, none))
    answer = F.concat(F.array(entry(no_record, info)), taken) if pages else taken
    entries = F.when(broken, F.array(entry(F.col("_corrupt_record"), none))).otherwise(answer)
    found = (
        lines.select(
            F.lit(source).alias("source"),
            "search_category",
            F.col("page").try_cast("int").alias("page"),
            parse_iso(F.col("fetched_at")).alias("fetched_at"),
            (~broken).alias("intact"),
            F.explode(entries).alias("entry"),
        )
        .select("source", "search_category", "page", "fetched_at", "intact", "entry.record", "entry.page_info")
        .withColumn("intact", F.col("intact") & is_json_object(F.col("record")))
    )
    return found if pages else found.drop("page_info")


def read_landing(spark: SparkSession, source: str, path: str, pages: bool = False) -> DataFrame:
    """Postings of one board: source, search_category, page, fetched_at, record (JSON text), intact; see ``records``."""
    return records(spark.read.schema(line_schema(source)).json(path), source, pages)


def read_landing_stream(
    spark: SparkSession, source: str, path: str, files_per_trigger: int = 1000, pages: bool = False
) -> DataFrame:
    """The same rows as a stream over newly arriving files."""
    lines = spark.readStream.schema(line_schema(source)).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return records(lines, source, pages)


def read_raw_pages(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Plain response files below ``search_category=…/page=…/fetched_at=…`` directories."""
    pages = spark.read.option("basePath", path).text(path, wholetext=True)
    body = F.from_json("value", body_type(source))
    broken = body.isNull() if source == "remoteok" else F.get_json_object("value", "$").isNull()
    # The time zone of a directory name is UTC.
    return records(
        pages.select(
            F.col("search_category").cast("string").alias("search_category"),
            F.col("page").cast("string").alias("page"),
            F.date_format(F.col("fetched_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"),
            F.lit(None).cast("string").alias("abort_reason"),
            body.alias("body"),
            F.when(broken, F.col("value")).alias("_corrupt_record"),
        ),
        source,
    )
