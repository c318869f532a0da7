"""Raw board answers derived from the given tables: one JSON record per posting and board shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.fixtures import bronze

_MOMENT = "yyyy-MM-dd'T'HH:mm:ss"


def _record(source: str) -> Column:
    """JSON text of one posting in the shape of a board."""
    c = F.col
    iso = F.date_format("posted_at", _MOMENT)
    place = F.concat(c("city"), F.lit(", "), c("state"))
    # Every seventh line number misses its id, as broken answers do.
    some_id = F.when(c("l_linenumber") != 3, c("source_id"))
    tags = F.when(c("p_size") < 10, F.array().cast("array<string>")).otherwise(
        F.array("category_tag", "search_category", F.lit("data"), F.lit("extra"))
    )
    shapes = {
        "adzuna": {
            "id": some_id,
            "title": F.concat(F.lit(" "), c("title"), F.lit(" ")),
            "description": c("description"),
            "company": F.struct(c("company").alias("display_name")),
            "location": F.struct(
                c("location").alias("display_name"),
                F.when(c("l_quantity") < 30, F.array(F.lit("Welt"), c("state"), c("city")))
                .otherwise(F.array(F.lit("Welt"), c("state"), F.lit("Kreis"), c("city")))
                .alias("area"),
            ),
            "salary_min": c("salary_min"),
            "salary_max": c("salary_max"),
            "salary_currency": F.when(c("currency") == "EUR", c("currency")).otherwise(F.lit("")),
            "contract_type": c("contract_type"),
            "contract_time": c("contract_time"),
            "category": F.struct(c("category_tag").alias("tag"), c("category_label").alias("label")),
            "created": F.concat(iso, F.lit("Z")),
            "redirect_url": c("url"),
        },
        "bundesagentur": {
            "refnr": some_id,
            "titel": F.when(c("p_size") > 20, c("title")).otherwise(F.lit("")),
            "beruf": c("search_category"),
            "arbeitgeber": c("company"),
            "arbeitsort": F.struct(
                c("city").alias("ort"),
                c("state").alias("region"),
                F.lit("Welt").alias("land"),
                F.struct(c("l_quantity").alias("lat"), (c("l_quantity") + 1).alias("lon")).alias("koordinaten"),
            ),
            "aktuelleVeroeffentlichungsdatum": F.when(
                c("l_returnflag") != "N", F.date_format("posted_at", "yyyy-MM-dd")
            ),
            "eintrittsdatum": F.date_format("fetched_at", "yyyy-MM-dd"),
        },
        "arbeitnow": {
            "slug": F.when(c("l_returnflag") != "N", c("source_id")),
            "id": c("l_partkey"),
            "title": c("title"),
            "description": c("description"),
            "company_name": c("company"),
            "location": F.coalesce("city", F.lit("")),
            "remote": c("region") == "Remote",
            "job_types": F.when(c("contract_type").isNotNull(), F.array("contract_type", F.lit("vollzeit"))),
            "tags": tags,
            "created_at": F.when(
                c("l_linestatus") == "F", F.unix_timestamp(c("posted_at").cast("timestamp")).cast("string")
            ).otherwise(F.concat(iso, F.lit("+02:00"))),
            "url": c("url"),
        },
        "jooble": {
            "id": c("l_partkey"),
            "title": c("title"),
            "snippet": c("description"),
            "company": c("company"),
            "location": c("location"),
            "salary": F.when(c("salary_min").isNull(), F.lit("")).otherwise(F.lit("3000 EUR")),
            "type": c("contract_type"),
            "updated": F.when(c("l_linestatus") == "F", F.concat(iso, F.lit(".0000000"))).otherwise(
                F.date_format("posted_at", "yyyy-MM-dd")
            ),
            "link": c("url"),
        },
        "jsearch": {
            "job_id": some_id,
            "job_title": F.when(c("p_size") != 7, c("title")),
            "job_description": c("description"),
            "employer_name": c("company"),
            "job_city": c("city"),
            "job_state": c("state"),
            "job_country": F.when(c("l_quantity") < 40, F.lit("DE")),
            "job_is_remote": c("region") == "Remote",
            "job_min_salary": F.when(c("l_linestatus") == "F", F.lit(0.0)).otherwise(c("salary_min")),
            "job_max_salary": c("salary_max"),
            "job_salary_currency": c("currency"),
            "job_employment_type": c("contract_type"),
            "job_publisher": c("search_category"),
            "job_posted_at_datetime_utc": F.concat(iso, F.lit(".000Z")),
            "job_apply_link": c("url"),
        },
        "muse": {
            "id": c("l_partkey"),
            "name": c("title"),
            "contents": c("description"),
            "company": F.struct(c("company").alias("name")),
            "locations": F.when(c("location").isNull(), F.array()).otherwise(
                F.array(F.struct(c("location").alias("name")), F.struct(F.lit("anderswo").alias("name")))
            ),
            "categories": F.array(F.struct(c("search_category").alias("name"))),
            "type": c("contract_type"),
            "publication_date": F.concat(iso, F.lit("Z")),
            "refs": F.struct(c("url").alias("landing_page")),
        },
        "remotive": {
            "id": c("l_partkey") + 1,
            "title": c("title"),
            "description": c("description"),
            "company_name": c("company"),
            "candidate_required_location": F.when(c("state") == "EUROPE", F.lit("Europe only"))
            .when(c("state") == "ASIA", F.lit("  "))
            .when(c("state") == "AFRICA", F.lit("Neuss"))
            .otherwise(place),
            "salary": F.when(c("salary_min").isNotNull(), F.lit("50k")),
            "job_type": c("contract_type"),
            "category": c("search_category"),
            "publication_date": iso,
            "url": c("url"),
        },
        "jobicy": {
            "id": c("l_partkey") + 1,
            "jobTitle": c("title"),
            "jobDescription": c("description"),
            "companyName": c("company"),
            "jobGeo": F.when(c("l_quantity") < 30, F.lit("Anywhere")).otherwise(place),
            "jobIndustry": F.array("search_category", F.lit("zweite")),
            "jobType": F.coalesce("contract_type", F.lit("")),
            "salaryMin": c("salary_min").cast("string"),
            "salaryMax": c("salary_max"),
            "salaryCurrency": F.when(c("l_linestatus") == "F", c("currency")),
            "pubDate": F.concat(F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")),
            "url": c("url"),
        },
        "remoteok": {
            "id": some_id,
            "position": c("title"),
            "description": c("description"),
            "company": c("company"),
            "location": F.when(c("l_quantity") < 20, F.lit("")).otherwise(place),
            "tags": tags,
            "date": F.concat(iso, F.lit("+00:00")),
            "apply_url": F.when(c("l_returnflag") == "A", c("url")).otherwise(F.lit("")),
            "url": F.concat(c("url"), F.lit("?src=list")),
        },
    }
    return F.to_json(F.struct(*[value.alias(name) for name, value in shapes[source].items()]))


def landing(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """All postings as the raw records one board would have sent."""
    return bronze(spark, sf_dir).select(
        F.lit(source).alias("source"),
        "search_category",
        F.col("l_linenumber").alias("page"),
        F.col("fetched_at").cast("timestamp").alias("fetched_at"),
        # As a page's list of postings is: the records are then written by compiled code, apart from their parsing.
        F.explode(F.array(_record(source))).alias("record"),
        F.lit(True).alias("intact"),
    )


def landing_lines(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The postings of one board as landing text lines, one page per order, fetched on its run day."""
    from stellwerk.sources.landing import ENVELOPES

    rows = bronze(spark, sf_dir).where(F.col("source") == source)
    pages = rows.groupBy(F.split_part("source_id", F.lit("-"), F.lit(1)).alias("page"), "run_day").agg(
        F.collect_list(_record(source)).alias("items")
    )
    body = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    for name in reversed([p for p in ENVELOPES[source].split(".") if p]):
        body = F.concat(F.lit('{"' + name + '":'), body, F.lit("}"))
    return pages.select(
        F.concat(
            F.lit('{"search_category":"all","page":'),
            "page",
            F.lit(',"fetched_at":"'),
            F.date_format("run_day", _MOMENT),
            F.lit('Z","body":'),
            body,
            F.lit("}"),
        ).alias("value")
    )


# Boards that no order priority stands for get the order lines of one number.
BOARD_LINES = {"arbeitnow": 1, "jooble": 2, "jsearch": 4, "remoteok": 6}
# What a board promises for this search is more than it sends.
PROMISED = ("PROMO", 1_000_000)
EMPTY_PAGE, ABORT = ("jobicy", 99), ("jsearch", 98, "Quota")


def board_rows(spark: SparkSession, sf_dir: str, source: str, stored: DataFrame | None = None) -> DataFrame:
    """What a board sends, from stored bronze rows if there are any.

    Line 5 has no posting date: its ties are settled by hashes of the content, which SQL lacks.
    """
    rows = (bronze(spark, sf_dir) if stored is None else stored).where("l_linenumber <> 5")
    return rows.where(F.col("l_linenumber") == BOARD_LINES[source] if source in BOARD_LINES else F.col("source") == source)


def _answer(source: str, items: Column, total: Column) -> Column:
    """A response around its postings, with the total where the board tells one."""
    from stellwerk.sources.landing import ENVELOPES, TOTALS

    body = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if ENVELOPES[source]:
        *outer, last = ENVELOPES[source].split(".")
        body = F.concat(F.lit(f'"{last}":'), body)
        beside = TOTALS.get(source, ("", 1))[0].split(".")
        if beside != [""]:
            told = F.concat(F.lit(f'"{beside[-1]}":'), total.cast("string"))
            for name in reversed(beside[:-1]):
                told = F.concat(F.lit('"' + name + '":{'), told, F.lit("}"))
            body = F.concat(told, F.lit(","), body)
        for name in reversed(outer):
            body = F.concat(F.lit('"' + name + '":{'), body, F.lit("}"))
        body = F.concat(F.lit("{"), body, F.lit("}"))
    return body


def landing_pages(spark: SparkSession, sf_dir: str, source: str, stored: DataFrame | None = None) -> DataFrame:
    """``run_day, value``: one board's answers as landing lines, by search, day and page, with empty pages and an abort.

    ``stored`` are the rows of ``bronze`` where several boards are made from them.
    """
    page = F.col("l_linenumber") + 10 * (F.col("l_partkey") % 5)
    pages = board_rows(spark, sf_dir, source, stored).groupBy("search_category", "run_day", page.cast("int").alias("page")).agg(
        F.collect_list(_record(source)).alias("items")
    )
    total = F.when(F.col("search_category") == PROMISED[0], F.lit(PROMISED[1])).otherwise(F.size("items"))
    lines = pages.select("search_category", "run_day", "page", _answer(source, F.col("items"), total).alias("body"))
    meta = [
        F.lit('{"search_category":"'), F.col("search_category"), F.lit('","page":'), F.col("page").cast("string"), F.lit(',"fetched_at":"'),
        F.date_format(F.col("run_day").cast("timestamp") + F.make_interval(hours=F.col("page") % 10), _MOMENT), F.lit('Z",'),
    ]
    text = [*meta, F.lit('"body":'), F.col("body"), F.lit("}")]
    found = lines.select("run_day", F.concat(*text).alias("value"))
    extra = pages.select("search_category", F.lit("1998-01-01").cast("date").alias("run_day")).distinct()
    if source == EMPTY_PAGE[0]:
        none = _answer(source, F.array().cast("array<string>"), F.lit(0))
        empty = extra.select("search_category", "run_day", F.lit(EMPTY_PAGE[1]).alias("page"), none.alias("body"))
        found = found.unionByName(empty.select("run_day", F.concat(*text).alias("value")))
    if source == ABORT[0]:
        stop = extra.where(F.col("search_category") == PROMISED[0]).select("*", F.lit(ABORT[1]).alias("page"))
        stopped = F.concat(*meta, F.lit(f'"abort_reason":"{ABORT[2]}"' + "}"))
        found = found.unionByName(stop.select("run_day", stopped.alias("value")))
    return found
