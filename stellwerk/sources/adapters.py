"""One adapter per job board: raw posting JSON to the common posting columns.

Each adapter declares the fields it reads and the columns it fills; the rest is NULL. In a board's
answer '', 0 and [] count as missing wherever a default applies. Fields whose JSON type matters for that are parsed as
VARIANT, in the one parse that each record gets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.functions.moments import (
    parse_day_or_second,
    parse_iso,
    parse_iso_or_epoch,
    parse_mislabelled_berlin,
)
from stellwerk.functions.text import blank_to_null, is_relevant_location
from stellwerk.schemas import COUNTRY, RAW, REMOTE, UNTITLED

BA_DETAIL_URL = "https://www.arbeitsagentur.de/jobsuche/jobdetail/"

def _r(field: str) -> Column:
    return F.col(f"r.{field}")


def _or(value: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(value), F.lit(default))


def _text(value: Column) -> Column:
    """A VARIANT field as text."""
    return F.try_variant_get(value, "$", "string")


def _given(value: Column) -> Column:
    """Does a VARIANT field count as given? By its JSON type: '', 0, false, null, [] and {} do not, "0" does."""
    kind, text = F.schema_of_variant(value), _text(value)
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(number != 0),
        F.lit(False),
    )


def _number(value: Column) -> Column:
    """A JSON number; numbers written as text are none."""
    return F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "double"))


def _positive_or_null(value: Column) -> Column:
    """Number from JSON number or text; 0 and '' are missing."""
    return F.when(_given(value), F.try_variant_get(value, "$", "double"))


def _joined(items: Column) -> Column:
    """Comma list; no items is NULL."""
    return blank_to_null(F.array_join(items, ", "))


def _first_of(value: Column) -> Column:
    """First element when a VARIANT field holds a list, else the value itself."""
    first = F.try_variant_get(value, "$[0]", "string")
    return blank_to_null(F.when(F.schema_of_variant(value).startswith("ARRAY"), first).otherwise(_text(value)))


def _project(landing: DataFrame, fields: str, columns: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """Parse and project. Records that are no JSON objects, and accounts of pages, stay with empty columns."""
    meta = ["source", "search_category", "fetched_at", "page", "record", "intact"]
    meta += ["page_info"] if "page_info" in landing.columns else []
    parsed = landing.select(*meta, F.from_json("record", fields).alias("r"))
    if keep is not None:
        # A filter would be pushed below the parsing and parse every record a second time.
        kept = F.when(keep | ~F.col("intact"), F.array("r"))
        parsed = parsed.select(*meta, F.explode(kept).alias("r"))
    return parsed.select(
        *[
            F.col(field.name)
            if field.name in meta
            else columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in RAW.fields
        ]
    )



def _filled(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def adapt_adzuna(landing: DataFrame) -> DataFrame:
    area = _r("location.area")
    # Numbers count as salaries, any other given value only as a sign that there is one.
    low, high = _r("salary_min"), _r("salary_max")
    return _project(
        landing,
        """id string, title string, description string, company struct<display_name: string>,
        location struct<display_name: string, area: array<string>>, salary_min variant, salary_max variant,
        salary_currency string, contract_type string, contract_time string,
        category struct<tag: string, label: string>, created string, redirect_url string,
        latitude double, longitude double""",
        {
            "source_id": _r("id"),
            "title": _or(F.trim(_r("title")), UNTITLED),
            "description": F.coalesce(_r("description"), F.lit("")),
            "company": _r("company.display_name"),
            "location": _r("location.display_name"),
            "location_segments": _filled(area),
            # From the country downwards: the fourth part is the city, else the third.
            "city": F.when(F.size(area) > 3, F.get(area, 3)).otherwise(F.get(area, 2)),
            "state": F.get(area, 1),
            "region": F.get(area, 1),
            "latitude": _r("latitude"),
            "longitude": _r("longitude"),
            "salary_min": _number(low),
            "salary_max": _number(high),
            "salary_present": _given(low) | _given(high),
            "currency": _or(_r("salary_currency"), "EUR"),
            "contract_type": _r("contract_type"),
            "contract_time": _r("contract_time"),
            "category_tag": _r("category.tag"),
            "category_label": _r("category.label"),
            "posted_at": parse_mislabelled_berlin(_r("created")),
            "url": _r("redirect_url"),
        },
        # 0 is an id, '' one that validation rejects.
        keep=_r("id").isNotNull(),
    )


def adapt_bundesagentur(landing: DataFrame) -> DataFrame:
    place = [blank_to_null(_r(f"arbeitsort.{part}")) for part in ("region", "land", "ort")]
    return _project(
        landing,
        """refnr string, titel string, beruf string, arbeitgeber string,
        arbeitsort struct<ort: string, region: string, land: string, koordinaten: struct<lat: double, lon: double>>,
        aktuelleVeroeffentlichungsdatum string, eintrittsdatum string""",
        {
            "source_id": _r("refnr"),
            "title": F.trim(F.coalesce(blank_to_null(_r("titel")), blank_to_null(_r("beruf")), F.lit(UNTITLED))),
            "description": F.lit(""),
            "company": _r("arbeitgeber"),
            "location": _r("arbeitsort.ort"),
            "location_segments": F.array_compact(F.array(*place)),
            "city": _r("arbeitsort.ort"),
            "state": _r("arbeitsort.region"),
            "region": _r("arbeitsort.region"),
            "latitude": _r("arbeitsort.koordinaten.lat"),
            "longitude": _r("arbeitsort.koordinaten.lon"),
            "salary_present": F.lit(False),
            "currency": F.lit("EUR"),
            "category_tag": _r("beruf"),
            "category_label": _r("beruf"),
            "posted_at": parse_iso(
                F.coalesce(blank_to_null(_r("aktuelleVeroeffentlichungsdatum")), _r("eintrittsdatum"))
            ),
            "url": F.concat(F.lit(BA_DETAIL_URL), _r("refnr")),
        },
        keep=blank_to_null(_r("refnr")).isNotNull(),
    )


def adapt_arbeitnow(landing: DataFrame) -> DataFrame:
    tags = _r("tags")
    return _project(
        landing,
        """slug string, id variant, title string, description string, company_name string, location string,
        remote boolean, job_types array<string>, tags array<string>, created_at string, url string""",
        {
            "source_id": F.coalesce(blank_to_null(_r("slug")), F.when(_given(_r("id")), _text(_r("id"))), F.lit("")),
            "title": _or(_r("title"), UNTITLED),
            "description": F.coalesce(_r("description"), F.lit("")),
            "company": _r("company_name"),
            "location": _r("location"),
            "location_segments": F.array(),
            "city": blank_to_null(_r("location")),
            "region": F.when(_r("remote"), F.lit(REMOTE)).otherwise(F.lit(COUNTRY)),
            "salary_present": F.lit(False),
            "currency": F.lit("EUR"),
            "contract_type": _joined(_r("job_types")),
            "category_tag": F.get(tags, 0),
            "category_label": F.when(F.size(tags) > 0, F.array_join(F.slice(tags, 1, 3), ", ")),
            "posted_at": parse_iso_or_epoch(_r("created_at")),
            "url": _r("url"),
        },
    )


def adapt_jooble(landing: DataFrame) -> DataFrame:
    return _project(
        landing,
        """id variant, title string, snippet string, company string, location string, salary variant, type string,
        updated string, link string""",
        {
            "source_id": F.when(_given(_r("id")), _text(_r("id"))).otherwise(F.lit("")),
            "title": _or(_r("title"), UNTITLED),
            "description": F.coalesce(_r("snippet"), F.lit("")),
            "company": _r("company"),
            "location": _r("location"),
            "location_segments": F.array(),
            "city": _r("location"),
            "salary_present": _given(_r("salary")),
            "currency": F.lit("EUR"),
            "contract_type": _r("type"),
            "posted_at": parse_day_or_second(_r("updated")),
            "url": _r("link"),
        },
    )


def adapt_jsearch(landing: DataFrame) -> DataFrame:
    low, high = _r("job_min_salary"), _r("job_max_salary")
    parts = [F.coalesce(_r(f"job_{part}"), F.lit("")) for part in ("city", "country")]
    return _project(
        landing,
        """job_id string, job_title string, job_description string, employer_name string, job_city string,
        job_state string, job_country string, job_is_remote boolean, job_min_salary variant, job_max_salary variant,
        job_salary_currency string, job_employment_type string, job_publisher string,
        job_posted_at_datetime_utc string, job_apply_link string""",
        {
            "source_id": _r("job_id"),
            "title": _r("job_title"),
            "description": F.coalesce(_r("job_description"), F.lit("")),
            "company": _r("employer_name"),
            "location": blank_to_null(F.trim(F.concat_ws(" ", *parts))),
            "location_segments": F.array(),
            "city": _r("job_city"),
            "state": _r("job_state"),
            "region": F.when(_r("job_is_remote"), F.lit(REMOTE)),
            "salary_min": _positive_or_null(low),
            "salary_max": _positive_or_null(high),
            "salary_present": _given(low) | _given(high),
            "currency": _or(_r("job_salary_currency"), "EUR"),
            "contract_type": _r("job_employment_type"),
            "category_tag": _r("job_publisher"),
            "category_label": _r("job_publisher"),
            "posted_at": parse_iso(_r("job_posted_at_datetime_utc")),
            "url": _r("job_apply_link"),
        },
        keep=blank_to_null(_r("job_id")).isNotNull() & blank_to_null(_r("job_title")).isNotNull(),
    )


def adapt_muse(landing: DataFrame) -> DataFrame:
    place = F.get(_r("locations"), 0)["name"]
    city = blank_to_null(F.trim(F.substring_index(place, ",", 1)))
    label = F.get(_r("categories"), 0)["name"]
    return _project(
        landing,
        """id variant, name string, contents string, company struct<name: string>,
        locations array<struct<name: string>>, categories array<struct<name: string>>, type string,
        publication_date string, refs struct<landing_page: string>""",
        {
            "source_id": _text(_r("id")),
            "title": _or(_r("name"), UNTITLED),
            "description": F.coalesce(_r("contents"), F.lit("")),
            "company": _r("company.name"),
            "location": place,
            "location_segments": F.array_compact(F.array(city)),
            "city": city,
            "salary_present": F.lit(False),
            "currency": F.lit("EUR"),
            "contract_type": _r("type"),
            "category_tag": label,
            "category_label": label,
            "posted_at": parse_iso(_r("publication_date")),
            "url": _r("refs.landing_page"),
        },
        keep=_given(_r("id")),
    )


def adapt_remotive(landing: DataFrame) -> DataFrame:
    return _project(
        landing,
        """id variant, title string, description string, company_name string, candidate_required_location string,
        salary variant, job_type string, category string, publication_date string, url string""",
        {
            "source_id": _text(_r("id")),
            "title": _or(_r("title"), UNTITLED),
            "description": F.coalesce(_r("description"), F.lit("")),
            "company": _r("company_name"),
            "location": _r("candidate_required_location"),
            "location_segments": F.array(),
            "region": F.lit(REMOTE),
            "salary_present": _given(_r("salary")),
            "currency": F.lit("EUR"),
            "contract_type": _r("job_type"),
            "category_tag": _r("category"),
            "category_label": _r("category"),
            "posted_at": parse_iso(_r("publication_date")),
            "url": _r("url"),
        },
        keep=_given(_r("id")) & is_relevant_location(_r("candidate_required_location")),
    )


def adapt_jobicy(landing: DataFrame) -> DataFrame:
    low, high = _r("salaryMin"), _r("salaryMax")
    industry = _first_of(_r("jobIndustry"))
    return _project(
        landing,
        """id variant, jobTitle string, jobDescription string, companyName string, jobGeo string, jobIndustry variant,
        jobType variant, salaryMin variant, salaryMax variant, salaryCurrency string, pubDate string, url string""",
        {
            "source_id": _text(_r("id")),
            "title": _or(_r("jobTitle"), UNTITLED),
            "description": F.coalesce(_r("jobDescription"), F.lit("")),
            "company": _r("companyName"),
            "location": _r("jobGeo"),
            "location_segments": F.array(),
            "region": F.lit(REMOTE),
            "salary_min": _positive_or_null(low),
            "salary_max": _positive_or_null(high),
            "salary_present": _given(low) | _given(high),
            "currency": _or(_r("salaryCurrency"), "EUR"),
            "contract_type": _first_of(_r("jobType")),
            "category_tag": industry,
            "category_label": industry,
            "posted_at": parse_iso(_r("pubDate")),
            "url": _r("url"),
        },
        keep=_given(_r("id")) & is_relevant_location(_r("jobGeo")),
    )


def adapt_remoteok(landing: DataFrame) -> DataFrame:
    """The first element of an answer is a notice without id and drops out."""
    tags = _r("tags")
    return _project(
        landing,
        """id variant, position string, description string, company string, location string, tags array<string>,
        date string, apply_url string, url string""",
        {
            "source_id": _text(_r("id")),
            "title": _or(_r("position"), UNTITLED),
            "description": F.coalesce(_r("description"), F.lit("")),
            "company": _r("company"),
            "location": _or(_r("location"), REMOTE),
            "location_segments": F.array(),
            "region": F.lit(REMOTE),
            "salary_present": F.lit(False),
            "currency": F.lit("USD"),
            "category_tag": F.get(tags, 0),
            "category_label": F.when(F.size(tags) > 0, F.array_join(F.slice(tags, 1, 3), ", ")),
            "posted_at": parse_iso(_r("date")),
            "url": F.coalesce(blank_to_null(_r("apply_url")), _r("url")),
        },
        keep=_given(_r("id")),
    )


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "bundesagentur": adapt_bundesagentur,
    "adzuna": adapt_adzuna,
    "arbeitnow": adapt_arbeitnow,
    "jooble": adapt_jooble,
    "jsearch": adapt_jsearch,
    "muse": adapt_muse,
    "remotive": adapt_remotive,
    "jobicy": adapt_jobicy,
    "remoteok": adapt_remoteok,
}
