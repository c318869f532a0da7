"""Every registered query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import fixtures as fx
from contract.landing_fixtures import landing, landing_lines, landing_pages
from stellwerk.functions import keys
from stellwerk.functions.text import norm_text
from stellwerk.operators import activity, dedup, metrics, quality, quota, silver, skills, validate, visits
from stellwerk.operators import gold as star
from stellwerk.operators.search import JobsFilter, matching_jobs, next_keyset, search, unseen_only
from stellwerk.plans import gold_upkeep
from stellwerk.plans import jobs as batch
from stellwerk.plans.scratch import written_once
from stellwerk.session import checkpoint_root
from stellwerk.sources import activity_store, lake, status
from stellwerk.sources.adapters import ADAPTERS
from stellwerk.sources.unify import filter_categories, filter_sources, with_keys
from stellwerk.sources.visit_log import parse_visit_lines
from stellwerk.streaming.incremental import run_incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def naive(column: str) -> Column:
    """Timestamps leave the engine without zone, as the SQL side has them."""
    return F.col(column).cast("timestamp_ntz").alias(column)


def money(column: str) -> Column:
    return F.round(column, 2).alias(column)


def joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


# ---- deduplication -----------------------------------------------------------------------------

_POSTING = ["source", "source_id", "title", "company", "fetched_at", "posted_at"]


@register("dedup_latest")
def dedup_latest(spark, sf_dir):
    return dedup.dedup_latest(fx.postings(spark, sf_dir), (), fx.ties()).select(*_POSTING)


@register("dedup_batch")
def dedup_batch(spark, sf_dir):
    return dedup.dedup_batch(fx.postings(spark, sf_dir), (), fx.ties()).select(*_POSTING)


@register("dedup_cross_source")
def dedup_cross_source(spark, sf_dir):
    return dedup.dedup_cross_source(fx.keyed_postings(spark, sf_dir), (), fx.ties()).select("dedup_key", *_POSTING)


@register("dedup_chain")
def dedup_chain(spark, sf_dir):
    rows = dedup.dedup_bronze(fx.stored_postings(spark, sf_dir), (), fx.ties(), with_keys)
    return rows.select("dedup_key", *_POSTING)


@register("dedup_across_days")
def dedup_across_days(spark, sf_dir):
    rows = dedup.dedup_across_days(fx.stored_silver(spark, sf_dir), [F.desc("run_day")])
    return rows.select("job_id", "run_day", naive("fetched_at"), "title_norm", "company_norm")


@register("dedup_title_company")
def dedup_title_company(spark, sf_dir):
    rows = dedup.dedup_title_company(fx.stored_silver(spark, sf_dir), [F.desc("run_day"), F.asc("job_id")])
    return rows.select("job_id", "run_day", naive("fetched_at"), "title_norm", "company_norm")


@register("job_keys")
def job_keys(spark, sf_dir):
    company = keys.company_key(F.col("company_norm"))
    place = keys.filled_location(F.col("city"), F.col("state"), F.col("region"))
    rows = fx.bronze(spark, sf_dir).withColumn("company_norm", F.lower(F.trim(F.coalesce("company", F.lit("")))))
    return rows.select(
        "source",
        "source_id",
        "job_id",
        "dedup_key",
        "source_priority",
        keys.company_id(company).alias("company_id"),
        keys.location_id(*place).alias("location_id"),
    )


# ---- silver and gold ---------------------------------------------------------------------------


@register("silver_projection")
def silver_projection(spark, sf_dir):
    rows = silver.project_silver(fx.bronze(spark, sf_dir), fx.PART_LEXICON)
    return rows.select(
        *[c for c in rows.columns if c != "skills"],
        joined("skills"),
    )


@register("silver_days")
def silver_days(spark, sf_dir):
    rows = fx.silver(spark, sf_dir)
    return rows.groupBy("run_day", "source").agg(
        F.count("*").alias("postings"), F.round(F.avg("salary_mid"), 2).alias("salary_mid")
    )


@register("source_filter")
def source_filter(spark, sf_dir):
    rows = filter_sources(fx.postings(spark, sf_dir), " Adzuna, muse,unknown ,,REMOTIVE")
    rows = rows.withColumnRenamed("category", "search_category")
    return filter_categories(rows, ["PROMO", "ECONOMY"]).select(*_POSTING, "search_category")


@register("dim_company")
def dim_company(spark, sf_dir):
    return star.build_dim_company(fx.staged(spark, sf_dir))


@register("dim_location")
def dim_location(spark, sf_dir):
    return star.build_dim_location(fx.staged(spark, sf_dir))


@register("fact_jobs")
def fact_jobs(spark, sf_dir):
    staged = fx.staged(spark, sf_dir)
    rows = star.build_fact_jobs(staged, star.build_dim_company(staged))
    return rows.select(*[c for c in rows.columns if c != "skills"], joined("skills"))


@register("fact_skills")
def fact_skills(spark, sf_dir):
    return star.build_fact_skills(fx.staged(spark, sf_dir))


@register("posting_calendar")
def posting_calendar(spark, sf_dir):
    """Calendar rows of the fetch days, with postings per day."""
    calendar = star.build_dim_date(spark, "2002-01-31", "1995-01-01")
    per_day = fx.postings(spark, sf_dir).groupBy(F.to_date("fetched_at").alias("date")).agg(F.count("*").alias("n"))
    return calendar.join(per_day, "date", "left").fillna(0, ["n"])


# ---- quality -----------------------------------------------------------------------------------


@register("chk_not_null")
def chk_not_null(spark, sf_dir):
    return quality.check_not_null(fx.bronze(spark, sf_dir), "company")


@register("chk_unique")
def chk_unique(spark, sf_dir):
    return quality.check_unique(fx.bronze(spark, sf_dir), "job_id")


@register("chk_accepted")
def chk_accepted(spark, sf_dir):
    return quality.check_accepted_values(fx.table(spark, sf_dir, "events"), "event_type", ["view", "click", "purchase"])


@register("chk_relationship")
def chk_relationship(spark, sf_dir):
    page = fx.table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    labels = fx.table(spark, sf_dir, "labels")
    return quality.check_relationship(page, "k", labels, "doc_id")


@register("quality_report")
def quality_report(spark, sf_dir):
    return quality.quality_report(fx.gold(spark, sf_dir), [s.canonical for s in fx.PART_LEXICON if s.canonical != "Rod"])


@register("null_negative_salary")
def null_negative_salary(spark, sf_dir):
    return validate.null_negative_salary(fx.table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


def _candidates(spark, sf_dir):
    """Postings with missing required fields and unknown boards."""
    rows = fx.bronze(spark, sf_dir)
    size, line = F.col("p_size"), F.col("l_linenumber")
    return rows.select(
        F.when(size == 9, F.lit("monster")).otherwise(F.col("source")).alias("source"),
        F.when(line == 2, F.lit("")).otherwise(F.col("source_id")).alias("source_id"),
        F.when((line == 3) & (size < 10), F.lit(None)).otherwise(F.col("title")).alias("title"),
        "search_category",
        F.when(size != 11, F.col("fetched_at")).alias("fetched_at"),
        (F.col("salary_min") - 20000).alias("salary_min"),
        "salary_max",
        line.alias("page"),
    )


@register("validate_split")
def validate_split(spark, sf_dir):
    valid, quarantine = validate.validate(_candidates(spark, sf_dir))
    columns = ["source", "source_id", "title", "fetched_at", "salary_min"]
    return valid.select(*columns, F.lit(None).cast("string").alias("reason"), F.lit("").alias("errors")).unionByName(
        quarantine.select(*columns, "reason", joined("errors"))
    )


def _report(spark, sf_dir):
    valid, quarantine = validate.validate(_candidates(spark, sf_dir))
    aborts = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        F.lit("jooble").alias("source"), F.lit("Quota").alias("abort_reason")
    )
    return validate.run_report(valid, quarantine, aborts)


@register("run_report")
def run_report(spark, sf_dir):
    return _report(spark, sf_dir)


@register("run_totals")
def run_totals(spark, sf_dir):
    return validate.run_totals(_report(spark, sf_dir))


@register("source_status")
def source_status(spark, sf_dir):
    return validate.source_status(_report(spark, sf_dir))


@register("status_summary")
def status_summary(spark, sf_dir):
    return validate.status_summary(validate.source_status(_report(spark, sf_dir)))


# ---- skills and text ---------------------------------------------------------------------------


@register("extract_skills")
def extract_skills(spark, sf_dir):
    docs = skills.with_skills(fx.table(spark, sf_dir, "documents"), "text", fx.DOCUMENT_LEXICON)
    return docs.select("doc_id", joined("skills"))


@register("extract_skills_standard")
def extract_skills_standard(spark, sf_dir):
    docs = skills.with_skills(fx.table(spark, sf_dir, "documents"), "text")
    found = docs.select(F.explode("skills").alias("skill"))
    return found.groupBy("skill").agg(F.count("*").alias("documents"))


@register("skill_category")
def skill_category(spark, sf_dir):
    words = fx.table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_name", " ", -1).alias("skill"))
    return skills.skill_category(words, skills.taxonomy_frame(spark, fx.PART_LEXICON))


@register("merge_taxonomies")
def merge_taxonomies(spark, sf_dir):
    """Part names as a second taxonomy next to the dictionary."""
    part = fx.table(spark, sf_dir, "part")
    word = F.initcap(F.substring_index("p_name", " ", -1))
    secondary = part.select(
        F.col("p_partkey").cast("int").alias("position"),
        F.concat_ws(" ", word, F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("canonical"),
        F.lower("p_type").alias("category"),
        F.array("p_brand").alias("synonyms"),
    )
    merged = skills.merge_taxonomies(skills.taxonomy_frame(spark, fx.PART_LEXICON), secondary)
    return merged.select("origin", "position", "canonical", "category", joined("synonyms"))


@register("norm_text")
def norm_documents(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(norm_text(F.col("text"))).alias("digest"))


# ---- search ------------------------------------------------------------------------------------


def _hits(spark, sf_dir, wanted: JobsFilter) -> DataFrame:
    rows = matching_jobs(fx.gold(spark, sf_dir), wanted)
    return rows.select("job_id", "source", "title", "company_id", "location_id", "posted_at", "salary_mid")


SEARCHES = {
    "search_text": JobsFilter(search="GIZMO"),
    "search_text_company": JobsFilter(search="000000_7"),
    "search_city": JobsFilter(city="nation_1"),
    "search_state": JobsFilter(state="europe"),
    "search_company": JobsFilter(company="#00000001"),
    "search_exact": JobsFilter(category="promo", contract_type="PERMANENT", contract_time="Full_Time", currency="eur"),
    "search_salary": JobsFilter(salary_min=30000, salary_max=60000, only_with_salary=True),
    "search_dates": JobsFilter(posted_since="1999-01-01T00:00:00", posted_until="2000-06-30"),
    "search_remote": JobsFilter(only_remote=True),
    "search_sources": JobsFilter(sources=["Muse", "ADZUNA"]),
    "search_skills_all": JobsFilter(skills=["Economy", "Widget"]),
    "search_combined": JobsFilter(
        search="ring", city="nation", salary_min=10000, sources=["bundesagentur", "adzuna"], skills=["Ring"]
    ),
}
for _name, _wanted in SEARCHES.items():
    QUERIES[_name] = lambda spark, sf_dir, wanted=_wanted: _hits(spark, sf_dir, wanted)


def _page(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[c for c in rows.columns if c != "skills"],
        joined("skills"),
    )


@register("search_page")
def search_page(spark, sf_dir):
    return _page(search(fx.gold(spark, sf_dir), JobsFilter(only_with_salary=True, limit=100)))


KEYSET = "1999-06-01T00:00:00|8"


@register("search_keyset")
def search_keyset(spark, sf_dir):
    return _page(search(fx.gold(spark, sf_dir), JobsFilter(after=KEYSET, limit=200)))


@register("unseen_only")
def unseen(spark, sf_dir):
    """Postings not yet seen by a user: each event marks the posting of an order as seen."""
    jobs = fx.gold(spark, sf_dir)["fact_jobs"]
    seen = fx.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), (F.col("user_id") % 3).cast("string")).alias("username"),
        F.col("event_id").alias("event_id"),
        F.when(F.col("event_type") == "error", F.array()).otherwise(F.array(F.lit("gesehen"))).alias("status"),
    )
    order_key = F.split_part("source_id", F.lit("-"), F.lit(1)).cast("bigint")
    posted = fx.bronze(spark, sf_dir).select("job_id", order_key.alias("event_id")).distinct()
    return unseen_only(jobs, seen.join(posted, "event_id"), "user_1").select("job_id", "source", "title")


# ---- metrics -----------------------------------------------------------------------------------


@register("facet_categories")
def facet_categories(spark, sf_dir):
    return metrics.facet_values(fx.gold(spark, sf_dir)["fact_jobs"], "category", keep_blank=True)


@register("facet_contract_times")
def facet_contract_times(spark, sf_dir):
    return metrics.facet_values(fx.gold(spark, sf_dir)["fact_jobs"], "contract_time")


@register("facets")
def facets(spark, sf_dir):
    return metrics.all_facets(fx.gold(spark, sf_dir))


@register("totals")
def totals(spark, sf_dir):
    rows = metrics.totals(fx.gold(spark, sf_dir)["fact_jobs"])
    return rows.select(*[c for c in rows.columns if c != "salary_mid"], money("salary_mid"))


@register("top_skills")
def top_skills(spark, sf_dir):
    return metrics.top_skills(fx.gold(spark, sf_dir)["fact_skills"], 5, 1)


@register("top_companies")
def top_companies(spark, sf_dir):
    return metrics.top_companies(fx.gold(spark, sf_dir), 20, 5).select("company", "jobs", money("salary_mid"))


@register("top_cities")
def top_cities(spark, sf_dir):
    return metrics.top_cities(fx.gold(spark, sf_dir)).select("city", "state", "jobs", money("salary_mid"))


@register("jobs_per_day")
def jobs_per_day(spark, sf_dir):
    return metrics.new_jobs_per_day(fx.gold(spark, sf_dir)["fact_jobs"], 365, fx.POSTINGS_AS_OF)


def _distribution(rows: DataFrame) -> DataFrame:
    """Interpolated quartiles of amounts in hundredths have up to seven decimals; eight keep them apart."""
    quartiles = [F.round(c, 8).alias(c) for c in ("salary_p25", "salary_median", "salary_p75")]
    return rows.select("grp", "n", *quartiles, money("salary_mid"))


for _group in metrics.DISTRIBUTION_GROUPS:
    QUERIES[f"salary_distribution_{_group}"] = lambda spark, sf_dir, group=_group: _distribution(
        metrics.salary_distribution_exact(fx.gold(spark, sf_dir), group)
    )


@register("salary_distribution_approx")
def salary_distribution_approx(spark, sf_dir):
    """Whether each approximate quartile lies within the promised rank error, by exact counts of smaller values."""
    accuracy, gold = 10_000, fx.gold(spark, sf_dir)
    names = ("salary_p25", "salary_median", "salary_p75")
    found = metrics.salary_distribution(gold, "source", accuracy).select("grp", "n", *names)
    # One row per board and quartile, so the join does not grow with a board's share.
    jobs = gold["fact_jobs"].where("salary_mid IS NOT NULL").select(F.col("source").alias("grp"), "salary_mid")
    counts = [
        F.sum((F.col("salary_mid") < F.col(c)).cast("bigint")).alias(f"below_{c}") for c in names
    ] + [F.sum((F.col("salary_mid") <= F.col(c)).cast("bigint")).alias(f"upto_{c}") for c in names]
    ranked = jobs.join(F.broadcast(found), "grp").groupBy("grp", "n").agg(*counts)
    error = F.col("n") / accuracy + 1
    within = [
        ((F.col(f"below_{c}") <= q * F.col("n") + error) & (F.col(f"upto_{c}") >= q * F.col("n") - error)).alias(c)
        for c, q in zip(names, metrics.QUARTILES)
    ]
    return ranked.select("grp", "n", *within)


@register("salary_quantiles_lineitem")
def salary_quantiles_lineitem(spark, sf_dir):
    """Exact quantiles over all order lines, without deduplication."""
    rows = metrics.exact_quantiles(fx.postings(spark, sf_dir), "source", "salary_min", (0.01, 0.5, 0.99))
    return rows.select("grp", "n", *[F.round(F.get("q", i), 7).alias(f"q{i}") for i in range(3)])


@register("salary_spread")
def salary_spread(spark, sf_dir):
    rows = metrics.salary_spread(metrics.salary_distribution_exact(fx.gold(spark, sf_dir), "state"))
    return rows.select("grp", money("median"), money("spread"), money("p25"))


@register("source_distribution")
def source_distribution(spark, sf_dir):
    rows = metrics.source_distribution(fx.gold(spark, sf_dir)["fact_jobs"])
    return rows.select("source", "jobs", money("salary_mid"))


@register("filter_ranking")
def filter_ranking(spark, sf_dir):
    ranking = metrics.top_companies(fx.gold(spark, sf_dir), 50)
    return metrics.filter_ranking(ranking, "company", "R#00000000").select("company", "jobs", money("salary_mid"))


# ---- visits ------------------------------------------------------------------------------------


def _visits(spark, sf_dir):
    return parse_visit_lines(fx.visit_lines(spark, sf_dir))


@register("visit_log")
def visit_log(spark, sf_dir):
    return _visits(spark, sf_dir)


@register("visit_totals")
def visit_totals(spark, sf_dir):
    return visits.visit_totals(_visits(spark, sf_dir), fx.AS_OF)


@register("visits_per_day")
def visits_per_day(spark, sf_dir):
    return visits.visits_per_day(_visits(spark, sf_dir), "2024-02-10")


@register("visits_top")
def visits_top(spark, sf_dir):
    return visits.visits_top(_visits(spark, sf_dir))


@register("page_referrers")
def page_referrers(spark, sf_dir):
    """Host and path of every page address."""
    return fx.table(spark, sf_dir, "pages").select(
        "page_id",
        visits.referrer_domain(F.col("url")).alias("domain"),
        visits.strip_query(F.col("url")).alias("bare_url"),
    )


@register("device_class")
def device_class(spark, sf_dir):
    rows = _visits(spark, sf_dir).select(visits.device_class(F.col("ua")).alias("device"))
    return rows.groupBy("device").agg(F.count("*").alias("n"))


@register("search_visits")
def search_visits(spark, sf_dir):
    return visits.search_visits(_visits(spark, sf_dir), " Frankreich ")


@register("exclude_paths")
def exclude_paths(spark, sf_dir):
    return visits.visits_newest_first(visits.exclude_paths(_visits(spark, sf_dir))).select("time", "ip", "path", "status")


# ---- activity and quota ------------------------------------------------------------------------


@register("activity_actions")
def activity_actions(spark, sf_dir):
    rows = activity.apply_actions(fx.actions(spark, sf_dir))
    return rows.select("username", "job_id", joined("status"), "saved_at")


@register("saved_jobs")
def saved_jobs(spark, sf_dir):
    return activity.saved_jobs(activity.apply_actions(fx.actions(spark, sf_dir))).select("username", "job_id", "saved_at")


@register("applied_jobs")
def applied_jobs(spark, sf_dir):
    return activity.applied_jobs(activity.apply_actions(fx.actions(spark, sf_dir))).select("username", "job_id", "saved_at")


@register("activity_counts")
def activity_counts(spark, sf_dir):
    return activity.activity_counts(activity.apply_actions(fx.actions(spark, sf_dir)))


@register("activity_upsert")
def activity_upsert(spark, sf_dir):
    rows = activity.upsert_activity(
        fx.stored_activity(spark, sf_dir), fx.late_payload(spark, sf_dir), "2024-02-01 00:00:00"
    )
    return rows.select("username", "job_id", joined("status"), "snapshot", "updated_at")


@register("activity_merge")
def activity_merge(spark, sf_dir):
    server = fx.stored_activity(spark, sf_dir)
    local = activity.upsert_activity(server.limit(0), fx.late_payload(spark, sf_dir), "2024-02-01 00:00:00")
    return activity.merge_activity(local, server).select("username", "job_id", joined("status"), "snapshot")


@register("valid_username")
def valid_username(spark, sf_dir):
    names = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("U"), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "view", F.col("user_id").cast("string"))
        .otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string")))
        .alias("username"),
    )
    return activity.valid_username(names)


@register("quota_usage")
def quota_usage(spark, sf_dir):
    usage = quota.quota_usage(fx.request_log(spark, sf_dir), fx.quota_limits(spark), fx.AS_OF)
    return quota.quota_flags(usage)


# ---- adapters ----------------------------------------------------------------------------------


def _adapted(spark, sf_dir, source):
    rows = ADAPTERS[source](landing(spark, sf_dir, source))
    return rows.select(
        "source_id",
        "title",
        F.md5("description").alias("description"),
        "company",
        "location",
        joined("location_segments"),
        "city",
        "state",
        "region",
        "latitude",
        "longitude",
        "salary_min",
        "salary_max",
        "salary_present",
        "currency",
        "contract_type",
        "category_tag",
        "category_label",
        naive("posted_at"),
        "url",
        "search_category",
        naive("fetched_at"),
    )


for _source in ADAPTERS:
    QUERIES[f"adapt_{_source}"] = lambda spark, sf_dir, source=_source: _adapted(spark, sf_dir, source)


# ---- jobs --------------------------------------------------------------------------------------


def _fresh_lake(spark) -> str:
    return f"{checkpoint_root(spark)}/lake-{uuid.uuid4().hex}"


@register("bronze_day")
def bronze_day(spark, sf_dir):
    """One day and one search category out of stored bronze; only those directories are read."""
    root = fx.bronze_lake(spark, sf_dir)
    rows = lake.read_bronze_day(spark, f"{root}/{batch.BRONZE}", "1997-01-01", ["a/m"])
    return rows.select("job_id", "source", "source_id", "title", naive("fetched_at"), "month", "day", "category", "run_day")


@register("backfill")
def backfill(spark, sf_dir):
    """Silver of four run days out of stored bronze; survivors per day."""
    root = fx.bronze_lake(spark, sf_dir)
    batch.refresh_silver(spark, root, "1996-01-01", "1999-06-30", taxonomy=fx.PART_LEXICON)
    silver_days = lake.read_silver(spark, f"{root}/{batch.SILVER}")
    return silver_days.groupBy("run_day").agg(F.count("*").alias("postings"), F.count_distinct("dedup_key").alias("keys"))


@register("incremental_run")
def incremental(spark, sf_dir):
    """Landing lines of three boards through the stream into silver; postings per day and board."""
    root = _fresh_lake(spark)
    sources = ["adzuna", "muse", "remotive"]
    for source in sources:
        landing_lines(spark, sf_dir, source).write.option("compression", "gzip").text(f"{root}/landing/{source}")
    run_incremental(
        spark,
        {source: f"{root}/landing/{source}" for source in sources},
        root,
        fx.PART_LEXICON,
        fx.CALENDAR_END,
    )
    bronze = lake.read_bronze(spark, f"{root}/{batch.BRONZE}")
    return bronze.groupBy("source", "year").agg(
        F.count("*").alias("postings"), F.count_distinct("job_id").alias("job_ids")
    )


def _once(spark, sf_dir, name: str, build: Callable[[str], None]) -> str:
    """Root of a lake that several queries read, built once per session."""
    key = (spark.sparkContext.applicationId, f"{name}:{fx._input_state(spark, sf_dir)}")
    if key not in fx._written:
        root = _fresh_lake(spark)
        build(root)
        fx._written[key] = root
    return fx._written[key]


_HALF = "1995-01-01"


def _nine_boards(spark, sf_dir) -> str:
    """Nine boards through the stream in two runs, and a third one that finds nothing new."""

    def build(root: str) -> None:
        paths = {source: f"{root}/landing/{source}" for source in ADAPTERS}
        with written_once(fx.bronze(spark, sf_dir).drop(*dedup.DERIVED), "bronze") as rows:
            pages = {source: landing_pages(spark, sf_dir, source, rows) for source in ADAPTERS}
            for part in (F.col("run_day") <= _HALF, F.col("run_day") > _HALF):
                for source, lines in pages.items():
                    lines.where(part).select("value").write.mode("append").option("compression", "gzip").text(paths[source])
                run_incremental(spark, paths, root, fx.PART_LEXICON, fx.CALENDAR_END)
        run_incremental(spark, paths, root, fx.PART_LEXICON, fx.CALENDAR_END)

    return _once(spark, sf_dir, "nine", build)


@register("incremental_silver")
def incremental_silver(spark, sf_dir):
    """Silver of nine boards after incremental runs, row by row."""
    rows = lake.read_silver(spark, f"{_nine_boards(spark, sf_dir)}/{batch.SILVER}")
    return rows.select("run_day", "source", "dedup_key", "title", "company", naive("fetched_at"), naive("posted_at"))


@register("incremental_gold")
def incremental_gold(spark, sf_dir):
    """Gold after the same runs: what each run brought up to date equals the facts of all days."""
    tables = lake.read_gold(spark, f"{_nine_boards(spark, sf_dir)}/{batch.GOLD}")
    return tables["fact_jobs"].select("source", "company_id", "location_id", "title", naive("fetched_at"), naive("posted_at"))


@register("ingest_report")
def ingest_report(spark, sf_dir):
    """Counters of nine boards: empty pages, a silent board, an aborted one, promised and fetched postings."""
    root = _fresh_lake(spark)
    paths = {source: f"{root}/landing/{source}" for source in ADAPTERS}
    for source in ADAPTERS:
        rows = landing_pages(spark, sf_dir, source)
        (rows.limit(0) if source == "remoteok" else rows).select("value").write.option("compression", "gzip").text(paths[source])
    return batch.ingest(spark, paths, root, "run", fx.POSTINGS_AS_OF)


def _observed(rows: DataFrame) -> DataFrame:
    """Silver rows, some of which are seen again a year later: line 1 with another salary, line 4 under another title."""
    line = F.substring_index("source_id", "-", -1)
    year = F.make_interval(years=F.lit(1))
    again = rows.where(line.isin("1", "4")).withColumns(
        {
            "run_day": F.add_months("run_day", 12),
            "fetched_at": F.col("fetched_at") + year,
            "salary_mid": F.when(line == "1", F.col("salary_mid") + 1).otherwise(F.col("salary_mid")),
            "title": F.when(line == "4", F.concat("title", F.lit(" II"))).otherwise(F.col("title")),
            "title_norm": F.when(line == "4", F.concat("title_norm", F.lit(" ii"))).otherwise(F.col("title_norm")),
        }
    )
    both = rows.unionByName(again)
    return both.withColumns({c: F.col(c).cast("timestamp") for c in ("posted_at", "fetched_at")}).select(*lake.SILVER.fieldNames())


def _kept_gold(spark, sf_dir) -> str:
    """Gold over days that come, grow, change and go."""

    def build(root: str) -> None:
        silver, kept = f"{root}/{batch.SILVER}", f"{root}/{batch.GOLD}"
        with fx.written_silver(spark, sf_dir) as days:
            rows, day = _observed(days), F.col("run_day")
            early = rows.where(day <= _HALF)
            # A first state that is wrong in three ways: half of 1994, other titles in 1995, a day of its own.
            wrong = early.where((F.year(day) != 1994) | (F.col("source") < "k")).withColumn(
                "title_norm", F.when(F.year(day) == 1995, F.lit("?")).otherwise(F.col("title_norm"))
            )
            stray = early.withColumns({"run_day": F.lit("2005-01-01").cast("date"), "fetched_at": F.lit("2005-01-01").cast("timestamp")})
            lake.write_silver(wrong.unionByName(stray.where("source = 'muse'")), silver)
            gold_upkeep.refresh(spark, silver, kept, fx.CALENDAR_END, buckets=8)
            lake.write_silver(early.where(F.year(day) >= 1994), silver, lake.days_between("2004-12-31", "2005-01-02"))
            gold_upkeep.refresh(spark, silver, kept, fx.CALENDAR_END)
            for late in (F.year(day) == 1996, F.year(day) > 1996):
                lake.write_silver(rows.where(late), silver)
                gold_upkeep.refresh(spark, silver, kept, fx.CALENDAR_END)

    return _once(spark, sf_dir, "kept", build)


@register("upkeep_fact_jobs")
def upkeep_fact_jobs(spark, sf_dir):
    """Facts after four updates, by job id."""
    tables = lake.read_gold(spark, f"{_kept_gold(spark, sf_dir)}/{batch.GOLD}")
    return tables["fact_jobs"].select(
        "job_id", "source", "company_id", "location_id", "title", "salary_mid", naive("fetched_at"), joined("skills")
    )


@register("upkeep_fact_skills")
def upkeep_fact_skills(spark, sf_dir):
    return lake.read_gold(spark, f"{_kept_gold(spark, sf_dir)}/{batch.GOLD}")["fact_skills"]


@register("upkeep_dimensions")
def upkeep_dimensions(spark, sf_dir):
    """Companies and places after the updates."""
    tables = lake.read_gold(spark, f"{_kept_gold(spark, sf_dir)}/{batch.GOLD}")
    place = F.concat_ws("|", "city", "state", "region")
    return (
        tables["dim_company"].select(F.lit("company").alias("kind"), F.col("company_id").alias("id"), F.col("company").alias("name"))
        .unionByName(tables["dim_location"].select(F.lit("place").alias("kind"), F.col("location_id").alias("id"), place.alias("name")))
    )


@register("backfill_rows")
def backfill_rows(spark, sf_dir):
    """Silver rows after a backfill over days one of which has lost its bronze."""
    stored = fx.bronze_lake(spark, sf_dir)
    root = _fresh_lake(spark)
    days = lake.read_bronze_days(spark, f"{stored}/{batch.BRONZE}", "1996-01-01", "1998-12-31")
    lake.write_bronze(days.drop(*lake.LOCATOR), f"{root}/{batch.BRONZE}", "copy")
    batch.backfill(spark, root, "1996-01-01", "1998-06-30", taxonomy=fx.PART_LEXICON)
    for source in [row.source for row in days.select("source").distinct().collect()]:
        lake.drop_folder(spark, f"{root}/{batch.BRONZE}/source={source}/year=1997")
    batch.backfill(spark, root, "1997-01-01", "1998-01-01", taxonomy=fx.PART_LEXICON)
    rows = lake.read_silver(spark, f"{root}/{batch.SILVER}")
    return rows.select("run_day", "source", "dedup_key", "title", "company", naive("fetched_at"), naive("posted_at"), "category")


# ---- stores ------------------------------------------------------------------------------------


@register("quarantine_rows")
def quarantine_rows(spark, sf_dir):
    """Rejected postings, written as JSON lines and read back."""
    _, rejected = validate.validate(_candidates(spark, sf_dir).withColumn("record", F.to_json(F.struct("source_id", "title"))))
    path = f"{_fresh_lake(spark)}/quarantine"
    lake.write_quarantine(rejected, path, "run", fx.POSTINGS_AS_OF)
    rows = lake.read_quarantine(spark, path)
    return rows.select("source", "reason", joined("errors"), "record", "search_category", "page", naive("fetched_at"), "month")


@register("silver_days_present")
def silver_days_present(spark, sf_dir):
    """Which days silver holds, asked day by day."""
    silver_root = f"{_kept_gold(spark, sf_dir)}/{batch.SILVER}"
    days = [f"{year}-01-01" for year in range(1990, 2006)]
    found = [(day, lake.silver_day_exists(spark, silver_root, day)) for day in days]
    return spark.createDataFrame(found, "day string, present boolean").select(F.col("day").cast("date").alias("day"), "present")


@register("run_status")
def run_status(spark, sf_dir):
    """Status of a run, written and read back: all boards, one of them with a quota."""
    used = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").agg(F.count("*").alias("used"))
    quota_rows = used.select(
        F.lit("jooble").alias("api"), "used", F.lit(1000).cast("bigint").alias("quota_limit"),
        F.round(F.col("used") / 10, 1).alias("percent"), F.lit(False).alias("monthly"), F.lit(None).cast("date").alias("reset_date"),
    )
    path = f"{_fresh_lake(spark)}/status"
    status.write_run_status(status.run_status(_report(spark, sf_dir), "run", f"{fx.AS_OF} 06:00:00", quota_rows), path)
    rows = status.read_run_status(spark, path)
    return rows.select("source", "label", "loaded", "valid", "quarantined", "aborted", "abort_reason", naive("run_at"), "quota.used", "quota.percent")


def _activity_store(spark, sf_dir) -> str:
    def build(root: str) -> None:
        rows = fx.stored_activity(spark, sf_dir).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
        # No snapshot is stored as an empty text.
        activity_store.write_activity(rows.withColumn("snapshot", F.coalesce("snapshot", F.lit(""))), f"{root}/activity")

    return f"{_once(spark, sf_dir, 'activity', build)}/activity"


def _stored(rows: DataFrame) -> DataFrame:
    return rows.select("username", "job_id", joined("status"), "snapshot", naive("updated_at"))


@register("activity_stored")
def activity_stored(spark, sf_dir):
    """Activity after a round trip through the store."""
    return _stored(activity_store.read_activity(spark, _activity_store(spark, sf_dir)))


@register("activity_of_user")
def activity_of_user(spark, sf_dir):
    return _stored(activity_store.read_activity(spark, _activity_store(spark, sf_dir), "user_7"))


def _loaded_taxonomy(spark, sf_dir) -> DataFrame:
    """A taxonomy file with gaps: a name for each part, categories and synonyms for some."""

    def build(root: str) -> None:
        part = fx.table(spark, sf_dir, "part")
        size = F.col("p_size")
        part.select(
            F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("canonical"),
            F.when(size > 30, F.col("p_type")).when(size > 20, F.lit("")).alias("category"),
            F.when(size % 2 == 0, F.array(F.lower("p_brand"), F.col("p_type"))).alias("synonyms"),
        ).write.json(f"{root}/taxonomy")

    return skills.load_taxonomy(spark, f"{_once(spark, sf_dir, 'taxonomy', build)}/taxonomy")


@register("load_taxonomy")
def load_taxonomy(spark, sf_dir):
    return _loaded_taxonomy(spark, sf_dir).select("canonical", "category", joined("synonyms"))


@register("canonical_skills")
def canonical_skills(spark, sf_dir):
    return skills.canonical_skills(_loaded_taxonomy(spark, sf_dir))


@register("next_keysets")
def next_keysets(spark, sf_dir):
    """The token after the first 60 dated and undated postings of each board."""
    tables = fx.gold(spark, sf_dir)
    found = []
    for source in sorted(ADAPTERS):
        page = search(tables, JobsFilter(sources=[source], limit=60))
        found.append((source, next_keyset(page, 60)))
    return spark.createDataFrame(found, "source string, token string")
