"""SQL that must give the same rows as the registered query of the same name."""

from __future__ import annotations

from contract.fixtures import AS_OF, DOCUMENT_LEXICON, PART_LEXICON, POSTINGS_AS_OF, QUOTA_LIMITS, USER_AGENTS
from contract.landing_fixtures import ABORT, BOARD_LINES, EMPTY_PAGE, PROMISED
from stellwerk.operators.skills import STANDARD_TAXONOMY
from stellwerk.schemas import SOURCES
from stellwerk.sources.landing import TOTALS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    def literal(v):
        return _text(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def _pattern(skill) -> str:
    spellings = "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in v) for v in (skill.canonical, *skill.synonyms))
    return f"(?i)(^|[^A-Za-z0-9_+#])({spellings})($|[^A-Za-z0-9_+#])"


def _skills(column: str, taxonomy) -> str:
    hits = ", ".join(
        f"CASE WHEN regexp_matches({column}, {_text(_pattern(s))}) THEN {_text(s.canonical)} END" for s in taxonomy
    )
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


_TIES = "posted_at DESC NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice, source, source_id"


def _first(table: str, keys: str, order: str) -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
        f"FROM {table}) WHERE rn = 1"
    )


_COMPANY = "lower(trim(coalesce(company, '')))"
_BATCH = f"source, lower(trim(title)), {_COMPANY}, date_trunc('hour', fetched_at)"
_KEY = f"left(sha256(lower(trim(title)) || '|' || {_COMPANY}), 24)"

_CTES = {
    "postings": """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'bundesagentur' WHEN '2-HIGH' THEN 'adzuna'
            WHEN '3-MEDIUM' THEN 'muse' WHEN '4-NOT SPECIFIED' THEN 'remotive' ELSE 'jobicy' END AS source,
       CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 90
            WHEN '3-MEDIUM' THEN 70 WHEN '4-NOT SPECIFIED' THEN 60 ELSE 50 END AS source_priority,
       concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS source_id,
       p_name AS title, s_name AS company, n_name AS city, r_name AS state,
       CASE WHEN l_returnflag = 'A' THEN 'Remote' ELSE NULL END AS region,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS salary_min,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_extendedprice END AS salary_max,
       p_type AS category, l_shipdate AS posted_at, o_orderdate AS fetched_at,
       l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber, l_returnflag, l_linestatus, l_tax,
       p_size, p_brand
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey""",
    "d1": _first("postings", "source, source_id", f"fetched_at DESC, {_TIES}"),
    "d2": _first("d1", _BATCH, f"fetched_at DESC, {_TIES}"),
    "bronze": f"""
SELECT * EXCLUDE (company), company, {_KEY} AS dedup_key,
       left(sha256(source || ':' || source_id), 24) AS job_id
FROM (SELECT source, source_priority, source_id, title, title || ' ' || category AS description,
       CASE l_quantity WHEN 13 THEN NULL WHEN 14 THEN '' ELSE company END AS company,
       CASE WHEN l_tax <> 0 THEN city || ', ' || state END AS location,
       CASE WHEN l_quantity < 10 THEN []::VARCHAR[] WHEN l_quantity < 25 THEN ['Welt', state]
            WHEN l_quantity < 40 THEN ['Welt', '', city] ELSE ['Welt', state, city] END AS segments,
       CASE WHEN l_linenumber <> 7 THEN city END AS city,
       CASE WHEN l_linenumber NOT IN (6, 7) THEN state END AS state,
       region, salary_min, salary_max,
       CASE WHEN l_linestatus = 'F' THEN 'EUR' ELSE 'USD' END AS currency,
       CASE l_returnflag WHEN 'A' THEN 'permanent' WHEN 'R' THEN 'contract' END AS contract_type,
       CASE WHEN l_linestatus = 'F' THEN 'full_time' ELSE '' END AS contract_time,
       p_brand AS category_tag, CASE WHEN p_size >= 5 THEN category END AS category_label,
       CASE WHEN l_linenumber <> 5 THEN posted_at END AS posted_at,
       'https://jobs.example/' || source_id AS url, category AS search_category, fetched_at,
       CAST(date_trunc('year', fetched_at) AS DATE) AS run_day,
       l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber, l_returnflag, l_linestatus, p_size
FROM postings)""",
    "b1": _first("bronze", "run_day, source, source_id", f"fetched_at DESC, {_TIES}"),
    "b2": _first("b1", f"run_day, {_BATCH}", f"fetched_at DESC, {_TIES}"),
    "b3": _first("b2", "run_day, dedup_key", f"source_priority DESC, fetched_at DESC, {_TIES}"),
}

_PROJECTION = f"""
SELECT job_id, source, source_id, title, lower(trim(title)) AS title_norm, description, company,
       {_COMPANY} AS company_norm,
       coalesce(city, nullif(segments[3], ''), nullif(segments[2], ''), location) AS city,
       coalesce(state, nullif(segments[2], ''), region) AS state, region, salary_min, salary_max,
       list_avg(list_filter([salary_min, salary_max], lambda x: x IS NOT NULL)) AS salary_mid,
       currency, contract_type, contract_time, coalesce(category_label, category_tag) AS category,
       posted_at, fetched_at, {_skills("description", PART_LEXICON)} AS skills, url, dedup_key, run_day"""

_CTES |= {
    "silver": f"{_PROJECTION} FROM b3",
    "s1": _first("silver", "job_id", "fetched_at DESC NULLS LAST, run_day DESC"),
    "staged": _first(
        "s1",
        "title_norm, coalesce(nullif(company_norm, ''), 'unbekannt')",
        "fetched_at DESC NULLS LAST, run_day DESC, job_id",
    ),
    "dim_company": """
SELECT md5(any_value(company_norm)) AS company_id, min(company) AS company, any_value(company_norm) AS company_norm
FROM (SELECT company, if(company_norm = '', 'unbekannt', company_norm) AS company_norm FROM staged WHERE company >= '')
GROUP BY company_norm""",
    "dim_location": """
SELECT DISTINCT md5(city || '|' || state || '|' || region) AS location_id, city, state, region
FROM (SELECT coalesce(city, 'unbekannt') AS city, coalesce(state, 'unbekannt') AS state,
             coalesce(region, 'Deutschland') AS region FROM staged)""",
    "fact_jobs": """
SELECT * EXCLUDE (title_norm, company, company_norm, city, state, region, dedup_key, run_day),
       CASE WHEN company_norm <> '' THEN md5(company_norm)
            WHEN EXISTS (FROM staged blank WHERE blank.company = '') THEN md5('unbekannt') END AS company_id,
       md5(concat_ws('|', coalesce(city, 'unbekannt'), coalesce(state, 'unbekannt'), coalesce(region, 'Deutschland'))) AS location_id
FROM staged""",
    "fact_skills": """
SELECT job_id, skill, count(*) AS weight FROM (SELECT job_id, unnest(skills) AS skill FROM staged) GROUP BY ALL""",
    "candidates": """
SELECT CASE WHEN p_size = 9 THEN 'monster' ELSE source END AS source,
       CASE WHEN l_linenumber = 2 THEN '' ELSE source_id END AS source_id,
       CASE WHEN l_linenumber = 3 AND p_size < 10 THEN NULL ELSE title END AS title, search_category,
       CASE WHEN p_size <> 11 THEN fetched_at END AS fetched_at, salary_min - 20000 AS salary_min,
       l_linenumber AS page
FROM bronze""",
    "judged": """
SELECT *, array_to_string(list_filter([
         CASE WHEN source = 'monster' THEN 'source' END, CASE WHEN source_id = '' THEN 'source_id' END,
         CASE WHEN title IS NULL THEN 'title' END, CASE WHEN fetched_at IS NULL THEN 'fetched_at' END],
         lambda x: x IS NOT NULL), '|') AS errors
FROM candidates""",
    "report": """
SELECT coalesce(r.source, a.source) AS source, coalesce(pages, 0)::BIGINT AS pages, coalesce(loaded, 0)::BIGINT AS loaded,
       coalesce(valid, 0)::BIGINT AS valid, coalesce(loaded - valid, 0)::BIGINT AS quarantined,
       a.source IS NOT NULL AS aborted, a.abort_reason
FROM (SELECT source, count(DISTINCT (search_category, page)) AS pages, count(*) AS loaded,
             count(*) FILTER (WHERE errors = '') AS valid FROM judged GROUP BY source) r
FULL JOIN (SELECT DISTINCT 'jooble' AS source, 'Quota' AS abort_reason FROM orders WHERE o_orderstatus = 'P') a
     ON a.source = r.source""",
    "boards": f"SELECT * FROM (VALUES {_values(SOURCES)}) AS t(source, source_priority, label)",
    "status": """
SELECT b.source, b.label, coalesce(loaded, 0)::BIGINT AS loaded, coalesce(valid, 0)::BIGINT AS valid,
       coalesce(quarantined, 0)::BIGINT AS quarantined, coalesce(aborted, false) AS aborted, abort_reason
FROM boards b LEFT JOIN report USING (source)""",
    "visits": f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' CET' AS time, '10.0.0.' || user_id AS ip,
       CASE WHEN user_id % 4 = 0 THEN 'lokal' ELSE
         CASE WHEN user_id % 3 = 0 THEN 'Deutschland' ELSE 'Frankreich' END || ' | Ort ' || (user_id % 25) || ' | Netz ' || (user_id % 9)
       END AS geo, 'GET' AS method,
       coalesce(regexp_replace(url, '^https?://[^/]+', ''), '/_next/static/app.js') AS path,
       CASE event_type WHEN 'error' THEN '500' WHEN 'purchase' THEN '201' ELSE '200' END AS status,
       [{", ".join(_text(a) for a in USER_AGENTS)}][(user_id % 7) + 1] AS ua,
       coalesce(CASE event_type WHEN 'view' THEN '-' WHEN 'signup' THEN ''
            WHEN 'click' THEN replace(url, '://', '://www.') ELSE url END, '-') AS referrer
FROM events LEFT JOIN pages ON page_id = CAST(json_extract_string(props, '$.k') AS BIGINT)""",
    "rated": """
SELECT *, CASE WHEN referrer IN ('', '-') THEN 'Direkt' ELSE replace(coalesce(nullif(
         regexp_extract(referrer, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), ''), referrer), 'www.', '') END AS domain,
       CASE WHEN ua = '-' THEN 'Unbekannt' WHEN ua LIKE '%Googlebot%' THEN 'Bot/Crawler'
            WHEN ua LIKE '%iPhone%' THEN 'Mobile' WHEN ua LIKE '%Windows%' THEN 'Windows'
            WHEN ua LIKE '%Macintosh%' THEN 'macOS' WHEN ua LIKE '%Linux%' THEN 'Linux' ELSE 'Sonstige' END AS device
FROM visits""",
    "actions": """
SELECT 'user_' || (user_id % 40) AS username, 'job_' || json_extract_string(props, '$.k') AS job_id, ts, event_type,
       row_number() OVER (PARTITION BY user_id % 40, json_extract_string(props, '$.k') ORDER BY ts, event_id) AS rn
FROM events""",
    "living": """
SELECT * FROM (SELECT *, coalesce(max(rn) FILTER (WHERE event_type = 'error')
                                 OVER (PARTITION BY username, job_id), 0) AS gone FROM actions) WHERE rn > gone""",
    # Bits: saved 2, applied 4.
    "entries": """
SELECT username, job_id, bool_or(event_type = 'view') AS seen, min(ts) AS saved_at,
       list_reduce(list_prepend(0, list(CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 11
              WHEN 'purchase' THEN 12 ELSE 13 END ORDER BY rn)),
         lambda s, a: CASE WHEN a = 11 THEN xor(s, 2) WHEN a = 12 THEN 6
              WHEN a = 13 THEN CASE WHEN s & 4 = 4 THEN s & 2 ELSE 6 END ELSE s END) AS state
FROM living GROUP BY username, job_id""",
    "activity": """
SELECT username, job_id, array_to_string(list_filter([CASE WHEN seen THEN 'gesehen' END,
         CASE WHEN state & 2 = 2 THEN 'gespeichert' END, CASE WHEN state & 4 = 4 THEN 'beworben' END],
         lambda x: x IS NOT NULL), '|') AS status, saved_at,
       state & 2 = 2 AS is_saved, state & 4 = 4 AS is_applied
FROM entries""",
    "payload": """
SELECT 'user_' || (user_id % 40) AS username, 'job_' || json_extract_string(props, '$.k') AS job_id,
       CASE event_type WHEN 'view' THEN ['gesehen'] WHEN 'click' THEN ['gesehen', 'gespeichert']
            WHEN 'purchase' THEN ['beworben', 'gespeichert'] ELSE []::VARCHAR[] END AS status,
       CASE WHEN value < 20 THEN NULL ELSE props END AS snapshot,
       CASE WHEN value < 10 THEN NULL WHEN value < 20 THEN '{}' ELSE props END AS raw_snapshot,
       event_id AS seq, ts
FROM events""",
    "stored": """
SELECT username, job_id, arg_max(status, seq) AS status,
       nullif(arg_max(raw_snapshot, seq) FILTER (WHERE raw_snapshot IS NOT NULL), '{}') AS any_snapshot, max(ts) AS updated_at,
       nullif(last(raw_snapshot ORDER BY seq), '{}') AS snapshot
FROM payload WHERE ts < TIMESTAMP '2024-01-16' GROUP BY username, job_id""",
    "late": """
SELECT username, job_id, last(status ORDER BY seq) AS status,
       arg_max(snapshot, seq) FILTER (WHERE snapshot IS NOT NULL) AS snapshot
FROM payload WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY username, job_id""",
    "usage": f"""
SELECT l.api, coalesce(sum(CASE WHEN c.api IS NULL THEN 0
                                WHEN l.monthly AND date_trunc('month', c.ts) <> date_trunc('month', DATE '{AS_OF}') THEN 0
                                ELSE 1 END), 0)::BIGINT AS used, l.quota_limit, l.monthly
FROM (SELECT api, quota_limit::BIGINT AS quota_limit, monthly FROM (VALUES {_values(QUOTA_LIMITS)}) AS t(api, quota_limit, monthly)) l
LEFT JOIN (SELECT event_type AS api, CAST(ts AS DATE) - to_months(CAST(user_id % 3 AS INT)) AS ts FROM events) c
     ON c.api = l.api AND c.ts <= DATE '{AS_OF}'
GROUP BY l.api, l.quota_limit, l.monthly""",
}

_WITH = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in _CTES.items()) + "\n"

ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str) -> None:
    ORACLE_SQL[name] = _WITH + sql


_POSTING = "source, source_id, title, company, fetched_at, posted_at"
_JOINED = "* REPLACE (array_to_string(skills, '|') AS skills)"

_add("dedup_latest", f"SELECT {_POSTING} FROM d1")
_add("dedup_batch", f"SELECT {_POSTING} FROM ({_first('postings', _BATCH, f'fetched_at DESC, {_TIES}')})")
_add(
    "dedup_cross_source",
    f"SELECT {_KEY} AS dedup_key, {_POSTING} FROM ({_first('postings', _KEY, f'source_priority DESC, fetched_at DESC, {_TIES}')})",
)
_add(
    "dedup_chain",
    f"SELECT {_KEY} AS dedup_key, {_POSTING} FROM ({_first('d2', _KEY, f'source_priority DESC, fetched_at DESC, {_TIES}')})",
)
_add("dedup_across_days", "SELECT job_id, run_day, fetched_at, title_norm, company_norm FROM s1")
_add(
    "dedup_title_company",
    "SELECT job_id, run_day, fetched_at, title_norm, company_norm FROM ("
    + _first(
        "silver",
        "title_norm, coalesce(nullif(company_norm, ''), 'unbekannt')",
        "fetched_at DESC NULLS LAST, run_day DESC, job_id",
    )
    + ")",
)
_add(
    "job_keys",
    f"""SELECT source, source_id, job_id, dedup_key, source_priority,
       md5(coalesce(nullif({_COMPANY}, ''), 'unbekannt')) AS company_id,
       md5(coalesce(city, 'unbekannt') || '|' || coalesce(state, 'unbekannt') || '|' || coalesce(region, 'Deutschland')) AS location_id
FROM bronze""",
)
_add("silver_projection", f"SELECT {_JOINED} FROM ({_PROJECTION} FROM bronze)")
_add(
    "silver_days",
    "SELECT run_day, source, count(*) AS postings, round(avg(salary_mid), 2) AS salary_mid FROM silver GROUP BY ALL",
)
_add(
    "source_filter",
    f"""SELECT {_POSTING}, category AS search_category FROM postings
WHERE source IN ('adzuna', 'muse', 'remotive') AND category IN ('PROMO', 'ECONOMY')""",
)
_add("dim_company", "SELECT * FROM dim_company")
_add("dim_location", "SELECT * FROM dim_location")
_add("fact_jobs", f"SELECT {_JOINED} FROM fact_jobs")
_add("fact_skills", "SELECT * FROM fact_skills")
_add(
    "posting_calendar",
    """SELECT d AS date, extract(year FROM d)::INT AS year, extract(quarter FROM d)::INT AS quarter,
       extract(month FROM d)::INT AS month, extract(week FROM d)::INT AS iso_week, extract(day FROM d)::INT AS day,
       extract(dow FROM d)::INT AS weekday_no,
       CASE extract(dow FROM d) WHEN 0 THEN 'Sonntag' WHEN 1 THEN 'Montag' WHEN 2 THEN 'Dienstag' WHEN 3 THEN 'Mittwoch'
            WHEN 4 THEN 'Donnerstag' WHEN 5 THEN 'Freitag' ELSE 'Samstag' END AS weekday, coalesce(n, 0) AS n
FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-01-31', INTERVAL 1 DAY)) AS DATE) AS d)
LEFT JOIN (SELECT CAST(fetched_at AS DATE) AS d, count(*) AS n FROM postings GROUP BY 1) USING (d)""",
)

# ---- quality -----------------------------------------------------------------------------------

_add("chk_not_null", "SELECT count(*) AS failures FROM bronze WHERE company IS NULL")
_add("chk_unique", "SELECT count(*) AS failures FROM (SELECT job_id FROM bronze GROUP BY 1 HAVING count(*) > 1)")
_add(
    "chk_accepted",
    "SELECT count(DISTINCT event_type) AS failures FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')",
)
_add(
    "chk_relationship",
    """SELECT count(*) AS failures FROM events
WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) NOT IN (SELECT doc_id FROM labels)""",
)
_NOT_NULL = [
    ("dim_company", "company_id"),
    ("dim_company", "company"),
    ("dim_location", "location_id"),
    ("fact_jobs", "job_id"),
    ("fact_jobs", "source"),
    ("fact_skills", "job_id"),
    ("fact_skills", "skill"),
]
_UNIQUE = [("dim_company", "company_id"), ("dim_location", "location_id"), ("fact_jobs", "job_id")]
_RELATED = [
    ("fact_jobs", "company_id", "dim_company"),
    ("fact_jobs", "location_id", "dim_location"),
    ("fact_skills", "job_id", "fact_jobs"),
]
_known_sources = ", ".join(_text(s[0]) for s in SOURCES)
_known_skills = ", ".join(_text(s.canonical) for s in PART_LEXICON if s.canonical != "Rod")
_checks = (
    [f"SELECT 'not_null', '{t}', '{c}', (SELECT count(*) FROM {t} WHERE {c} IS NULL)" for t, c in _NOT_NULL]
    + [
        f"SELECT 'unique', '{t}', '{c}', (SELECT count(*) FROM (SELECT {c} FROM {t} GROUP BY 1 HAVING count(*) > 1))"
        for t, c in _UNIQUE
    ]
    + [f"SELECT 'relationships', '{t}', '{c}', (SELECT count(*) FROM {t} WHERE {c} NOT IN (SELECT {c} FROM {p}))" for t, c, p in _RELATED]
    + [
        f"SELECT 'accepted_values', '{t}', '{c}', (SELECT count(DISTINCT {c}) FROM {t} WHERE {c} NOT IN ({v}))"
        for t, c, v in [("fact_jobs", "source", _known_sources), ("fact_skills", "skill", _known_skills)]
    ]
    + ["SELECT 'not_null', 'dim_date', 'date', 0", "SELECT 'unique', 'dim_date', 'date', 0"]
)
_add(
    "quality_report",
    "SELECT check_name, table_name, column_name, failures::BIGINT AS failures, failures = 0 AS ok FROM ("
    + " UNION ALL ".join(_checks)
    + ") AS t(check_name, table_name, column_name, failures)",
)
_add(
    "null_negative_salary",
    "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer",
)
_add(
    "validate_split",
    """SELECT source, source_id, title, fetched_at,
       CASE WHEN errors <> '' OR salary_min >= 0 THEN salary_min END AS salary_min,
       CASE WHEN errors <> '' THEN 'schema_verletzung' END AS reason, errors FROM judged""",
)
_add("run_report", "SELECT * FROM report")
_add(
    "run_totals",
    "SELECT sum(loaded)::BIGINT AS loaded, sum(valid)::BIGINT AS valid, sum(quarantined)::BIGINT AS quarantined FROM report",
)
_add("source_status", "SELECT * FROM status")
_add(
    "status_summary",
    """SELECT count(*) FILTER (WHERE aborted) AS aborted, count(*) FILTER (WHERE NOT aborted AND loaded > 0) AS active
FROM status""",
)

# ---- skills and text ---------------------------------------------------------------------------

_add(
    "extract_skills",
    f"SELECT doc_id, array_to_string({_skills('text', DOCUMENT_LEXICON)}, '|') AS skills FROM documents",
)
_add(
    "extract_skills_standard",
    f"""SELECT skill, count(*) AS documents
FROM (SELECT unnest({_skills('text', STANDARD_TAXONOMY)}) AS skill FROM documents) GROUP BY skill""",
)
_lexicon = _values([(i, s.canonical, s.category, "|".join(s.synonyms)) for i, s in enumerate(PART_LEXICON)])
_add(
    "skill_category",
    f"""SELECT p_partkey, word AS skill, category AS skill_category
FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS word FROM part)
LEFT JOIN (VALUES {_lexicon}) AS t(position, canonical, category, synonyms) ON lower(canonical) = lower(word)""",
)
_add(
    "merge_taxonomies",
    f"""SELECT 'primary' AS origin, position::INT AS position, canonical, category, synonyms
FROM (VALUES {_lexicon}) AS t(position, canonical, category, synonyms)
UNION ALL
SELECT 'secondary', position, canonical, category, synonyms FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(canonical) ORDER BY position) AS rn FROM (
    SELECT p_partkey::INT AS position, lower(p_type) AS category, p_brand AS synonyms,
           upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2)
             || CASE WHEN p_size > 25 THEN ' ' || p_brand ELSE '' END AS canonical
    FROM part))
WHERE rn = 1 AND lower(canonical) NOT IN (SELECT lower(canonical) FROM (VALUES {_lexicon}) AS t(position, canonical, category, synonyms))""",
)
_add(
    "norm_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS digest FROM documents""",
)

# ---- search ------------------------------------------------------------------------------------

_HITS = """SELECT f.job_id, f.source, f.title, f.company_id, f.location_id, f.posted_at, f.salary_mid
FROM fact_jobs f LEFT JOIN dim_company d ON d.company_id = f.company_id
LEFT JOIN dim_location s ON s.location_id = f.location_id WHERE """
_HAS = "EXISTS (SELECT 1 FROM fact_skills k WHERE k.job_id = f.job_id AND k.skill = '{}')"
_WHERES = {
    "search_text": "lower(f.title) LIKE '%gizmo%' OR lower(coalesce(d.company_norm, '')) LIKE '%gizmo%'",
    "search_text_company": "lower(f.title) LIKE '%000000_7%' OR lower(coalesce(d.company_norm, '')) LIKE '%000000_7%'",
    "search_city": "lower(s.city) LIKE '%nation_1%'",
    "search_state": "lower(s.state) = 'europe'",
    "search_company": "lower(d.company_norm) LIKE '%#00000001%'",
    "search_exact": """lower(f.category) = 'promo' AND lower(f.contract_type) = 'permanent'
        AND lower(f.contract_time) = 'full_time' AND upper(f.currency) = 'EUR'""",
    "search_salary": """coalesce(f.salary_mid, f.salary_max) >= 30000 AND coalesce(f.salary_mid, f.salary_min) <= 60000
        AND f.salary_mid IS NOT NULL""",
    "search_dates": "f.posted_at >= TIMESTAMP '1999-01-01' AND f.posted_at <= TIMESTAMP '2000-06-30'",
    "search_remote": "s.region = 'Remote'",
    "search_sources": "lower(f.source) IN ('muse', 'adzuna')",
    "search_skills_all": f"{_HAS.format('Economy')} AND {_HAS.format('Widget')}",
    "search_combined": f"""(lower(f.title) LIKE '%ring%' OR lower(coalesce(d.company_norm, '')) LIKE '%ring%')
        AND lower(s.city) LIKE '%nation%' AND coalesce(f.salary_mid, f.salary_max) >= 10000
        AND lower(f.source) IN ('bundesagentur', 'adzuna') AND {_HAS.format('Ring')}""",
}
for _name, _where in _WHERES.items():
    _add(_name, _HITS + _where)

_PAGE = """SELECT f.job_id, f.source, f.source_id, f.title, d.company, s.city, s.state, f.salary_min, f.salary_max,
       f.salary_mid, f.currency, f.contract_type, f.contract_time, f.posted_at, f.category,
       array_to_string(f.skills, '|') AS skills, f.url
FROM fact_jobs f LEFT JOIN dim_company d ON d.company_id = f.company_id
LEFT JOIN dim_location s ON s.location_id = f.location_id WHERE """
_ORDER = " ORDER BY f.posted_at DESC NULLS LAST, f.job_id DESC LIMIT "
_add("search_page", _PAGE + "f.salary_mid IS NOT NULL" + _ORDER + "100")
_add("search_keyset", _PAGE + "(f.posted_at, f.job_id) < (TIMESTAMP '1999-06-01', '8')" + _ORDER + "200")
_add(
    "unseen_only",
    """SELECT job_id, source, title FROM fact_jobs WHERE job_id NOT IN (
  SELECT b.job_id FROM bronze b JOIN events e ON e.event_id = CAST(split_part(b.source_id, '-', 1) AS BIGINT)
  WHERE e.user_id % 3 = 1 AND e.event_type <> 'error')""",
)

# ---- metrics -----------------------------------------------------------------------------------

_CITIES = """SELECT s.city AS value, count(*) AS n FROM fact_jobs f JOIN dim_location s USING (location_id)
WHERE s.city IS NOT NULL AND s.city NOT IN ('', 'unbekannt') GROUP BY 1 ORDER BY n DESC, value LIMIT 50"""
_add("facet_categories", "SELECT DISTINCT category AS value FROM fact_jobs WHERE category IS NOT NULL")
_add("facet_contract_times", "SELECT DISTINCT contract_time AS value FROM fact_jobs WHERE contract_time <> ''")
_add(
    "facets",
    f"""SELECT 'categories' AS facet, category AS value, NULL::BIGINT AS n FROM fact_jobs WHERE category IS NOT NULL GROUP BY 2
UNION ALL SELECT 'contract_types', contract_type, NULL FROM fact_jobs WHERE contract_type <> '' GROUP BY 2
UNION ALL SELECT 'contract_times', contract_time, NULL FROM fact_jobs WHERE contract_time <> '' GROUP BY 2
UNION ALL SELECT 'states', state, NULL FROM dim_location WHERE state NOT IN ('', 'unbekannt') GROUP BY 2
UNION ALL SELECT 'cities', value, n FROM ({_CITIES})
UNION ALL SELECT 'skills', skill, n FROM (SELECT skill, count(*) AS n FROM fact_skills GROUP BY 1 ORDER BY n DESC, skill LIMIT 50)
UNION ALL SELECT 'sources', source, count(*) FROM fact_jobs GROUP BY 2""",
)
_add(
    "totals",
    """SELECT count(*) AS jobs, count(DISTINCT company_id) AS companies, count(DISTINCT location_id) AS locations,
       count(DISTINCT source) AS sources, min(posted_at) AS first_posted_at, max(posted_at) AS last_posted_at,
       round(avg(salary_mid), 2) AS salary_mid FROM fact_jobs""",
)
_add(
    "top_skills",
    """SELECT skill, count(*) AS n, count(DISTINCT job_id) AS jobs FROM fact_skills GROUP BY skill
ORDER BY n DESC, skill LIMIT 5 OFFSET 1""",
)
_COMPANIES = """SELECT d.company, count(*) AS jobs, round(avg(f.salary_mid), 2) AS salary_mid
FROM fact_jobs f JOIN dim_company d USING (company_id) WHERE d.company IS NOT NULL
GROUP BY d.company ORDER BY jobs DESC, d.company"""
_add("top_companies", _COMPANIES + " LIMIT 20 OFFSET 5")
_add(
    "top_cities",
    """SELECT s.city, s.state, count(*) AS jobs, round(avg(f.salary_mid), 2) AS salary_mid
FROM fact_jobs f JOIN dim_location s USING (location_id) WHERE s.city IS NOT NULL
GROUP BY s.city, s.state ORDER BY jobs DESC, s.city, s.state LIMIT 20""",
)
_add(
    "jobs_per_day",
    f"""SELECT CAST(posted_at AS DATE) AS day, count(*) AS n FROM fact_jobs
WHERE posted_at >= DATE '{POSTINGS_AS_OF}' - INTERVAL 365 DAY GROUP BY 1""",
)


def _distribution(column: str, digits: int = 8) -> str:
    quartiles = ", ".join(
        f"round(quantile_cont(f.salary_mid, {q}), {digits}) AS {name}"
        for q, name in ((0.25, "salary_p25"), (0.5, "salary_median"), (0.75, "salary_p75"))
    )
    return f"""SELECT * FROM (SELECT {column} AS grp, count(*) AS n, {quartiles}, round(avg(f.salary_mid), 2) AS salary_mid
FROM fact_jobs f LEFT JOIN dim_location s USING (location_id)
WHERE f.salary_mid IS NOT NULL AND {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, grp LIMIT 25) WHERE grp <> ''"""


for _group, _column in {"category": "f.category", "city": "s.city", "state": "s.state", "source": "f.source"}.items():
    _add(f"salary_distribution_{_group}", _distribution(_column))
_add(
    "salary_distribution_approx",
    """SELECT source AS grp, count(salary_mid) AS n, true AS salary_p25, true AS salary_median, true AS salary_p75
FROM fact_jobs WHERE salary_mid IS NOT NULL GROUP BY source""",
)
_add(
    "salary_quantiles_lineitem",
    """SELECT source AS grp, count(*) AS n, round(quantile_cont(salary_min, 0.01), 7) AS q0,
       round(quantile_cont(salary_min, 0.5), 7) AS q1, round(quantile_cont(salary_min, 0.99), 7) AS q2
FROM postings WHERE salary_min IS NOT NULL GROUP BY 1""",
)
_add(
    "salary_spread",
    f"""SELECT grp, round(salary_median, 2) AS median, round(greatest(0, salary_p75 - salary_p25), 2) AS spread,
       round(salary_p25, 2) AS p25 FROM ({_distribution('s.state')})""",
)
_add(
    "source_distribution",
    "SELECT source, count(*) AS jobs, round(avg(salary_mid), 2) AS salary_mid FROM fact_jobs GROUP BY source",
)
_add("filter_ranking", f"SELECT * FROM ({_COMPANIES} LIMIT 50) WHERE lower(company) LIKE '%r#00000000%'")

# ---- visits ------------------------------------------------------------------------------------

_add("visit_log", "SELECT * FROM visits")
_add(
    "visit_totals",
    f"""SELECT count(*) AS visits, count(DISTINCT ip) AS distinct_ips,
       count(*) FILTER (WHERE left(time, 10) = '{AS_OF}') AS today,
       count(*) FILTER (WHERE CAST(left(time, 10) AS DATE) BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}') AS last_7_days,
       count(*) FILTER (WHERE left(time, 7) = left('{AS_OF}', 7)) AS this_month FROM visits""",
)
_add(
    "visits_per_day",
    """SELECT CAST(d AS DATE) AS day, count(time) AS n
FROM (SELECT unnest(generate_series(DATE '2024-02-10' - 29, DATE '2024-02-10', INTERVAL 1 DAY)) AS d)
LEFT JOIN visits ON left(time, 10) = strftime(d, '%Y-%m-%d') GROUP BY 1""",
)
_DIMENSIONS = {
    "country": "trim(split_part(geo, '|', 1))",
    "city": "CASE WHEN geo LIKE '%|%' THEN trim(split_part(geo, '|', 2)) ELSE '?' END",
    "isp": "CASE WHEN geo LIKE '%|%' THEN trim(split_part(geo, '|', 3)) ELSE '?' END",
    "path": "split_part(path, '?', 1)",
    "referrer": "domain",
    "status": "status",
    "device": "device",
}
_add(
    "visits_top",
    "SELECT dimension, name, n, rank FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, {e} AS name, count(*) AS n,
       (row_number() OVER (ORDER BY count(*) DESC, {e}))::INT AS rank FROM rated GROUP BY 2"""
        for d, e in _DIMENSIONS.items()
    )
    + ") WHERE rank <= CASE dimension WHEN 'status' THEN 20 ELSE 10 END",
)
_add(
    "page_referrers",
    """SELECT page_id, replace(regexp_extract(url, '//([^/?#]*)', 1), 'www.', '') AS domain,
       split_part(url, '?', 1) AS bare_url FROM pages""",
)
_add("device_class", "SELECT device, count(*) AS n FROM rated GROUP BY device")
_add("search_visits", "SELECT * FROM visits WHERE lower(geo) LIKE '%frankreich%'")
_add("exclude_paths", "SELECT time, ip, path, status FROM visits WHERE path NOT LIKE '/\\_next/%' ESCAPE '\\'")

# ---- activity and quota ------------------------------------------------------------------------

_add("activity_actions", "SELECT username, job_id, status, saved_at FROM activity")
_add("applied_jobs", "SELECT username, job_id, saved_at FROM activity WHERE is_applied")
_add("saved_jobs", "SELECT username, job_id, saved_at FROM activity WHERE is_saved")
_add(
    "activity_counts",
    """SELECT username, count(*) FILTER (WHERE is_saved) AS saved, count(*) FILTER (WHERE is_applied) AS applied
FROM activity GROUP BY username""",
)
_add(
    "activity_upsert",
    """SELECT coalesce(l.username, b.username) AS username, coalesce(l.job_id, b.job_id) AS job_id,
       array_to_string(CASE WHEN l.username IS NOT NULL THEN l.status ELSE b.status END, '|') AS status,
       coalesce(l.snapshot, b.snapshot) AS snapshot,
       CASE WHEN l.username IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE b.updated_at END AS updated_at
FROM stored b FULL JOIN late l ON l.username = b.username AND l.job_id = b.job_id""",
)
_add(
    "activity_merge",
    """SELECT coalesce(l.username, b.username) AS username, coalesce(l.job_id, b.job_id) AS job_id,
       array_to_string(CASE WHEN l.username IS NULL THEN b.status WHEN b.username IS NULL THEN l.status
         ELSE list_filter(['beworben', 'gespeichert', 'gesehen'],
                          lambda s: list_contains(l.status, s) OR list_contains(b.status, s)) END, '|') AS status,
       coalesce(l.snapshot, b.snapshot) AS snapshot
FROM stored b FULL JOIN late l ON l.username = b.username AND l.job_id = b.job_id""",
)
_add(
    "valid_username",
    """SELECT * FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'U' || user_id WHEN 'view' THEN user_id::VARCHAR
       ELSE 'user_' || user_id END AS username FROM events) WHERE regexp_matches(username, '^[a-z0-9_]{3,30}$')""",
)
_add(
    "quota_usage",
    f"""SELECT api, used, quota_limit, round(used / quota_limit * 100, 1) AS percent, monthly,
       CASE WHEN monthly THEN CAST(date_trunc('month', DATE '{AS_OF}') AS DATE) END AS reset_date,
       used >= quota_limit AS exhausted, used >= 0.8 * quota_limit AS warn FROM usage""",
)

# ---- adapters ----------------------------------------------------------------------------------

_PLACE = "city || ', ' || state"
_ADAPTED = {
    "source_id": "source_id",
    "title": "title",
    "description": "md5(description)",
    "company": "company",
    "location": "location",
    "location_segments": "''",
    "city": "NULL::VARCHAR",
    "state": "NULL::VARCHAR",
    "region": "NULL::VARCHAR",
    "latitude": "NULL::DOUBLE",
    "longitude": "NULL::DOUBLE",
    "salary_min": "NULL::DOUBLE",
    "salary_max": "NULL::DOUBLE",
    "salary_present": "false",
    "currency": "'EUR'",
    "contract_type": "contract_type",
    "category_tag": "search_category",
    "category_label": "search_category",
    "posted_at": "posted_at",
    "url": "url",
    "search_category": "search_category",
    "fetched_at": "fetched_at",
}
_PART_ID = "CASE WHEN l_partkey = 0 THEN '' ELSE l_partkey::VARCHAR END"
_PAID = "salary_min IS NOT NULL OR salary_max IS NOT NULL"
_TAGS = {
    "category_tag": "CASE WHEN p_size >= 10 THEN category_tag END",
    "category_label": "CASE WHEN p_size >= 10 THEN category_tag || ', ' || search_category || ', data' END",
}
_ADAPTERS: dict[str, tuple[dict[str, str], str]] = {
    "adzuna": (
        {
            "location_segments": """array_to_string(CASE WHEN l_quantity < 30 THEN ['Welt', state, city]
                                     ELSE ['Welt', state, 'Kreis', city] END, '|')""",
            "city": "city",
            "state": "state",
            "region": "state",
            "salary_min": "salary_min",
            "salary_max": "salary_max",
            "salary_present": _PAID,
            "category_tag": "category_tag",
            "category_label": "category_label",
            "posted_at": "(posted_at AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC'",
        },
        "l_linenumber <> 3",
    ),
    "bundesagentur": (
        {
            "title": "CASE WHEN p_size > 20 THEN title ELSE search_category END",
            "description": "md5('')",
            "location": "city",
            "location_segments": "array_to_string([state, 'Welt', city], '|')",
            "city": "city",
            "state": "state",
            "region": "state",
            "latitude": "l_quantity",
            "longitude": "l_quantity + 1",
            "contract_type": "NULL::VARCHAR",
            "posted_at": "CAST(coalesce(CASE WHEN l_returnflag <> 'N' THEN posted_at END, fetched_at) AS TIMESTAMP)",
            "url": "'https://www.arbeitsagentur.de/jobsuche/jobdetail/' || source_id",
        },
        "l_linenumber <> 3",
    ),
    "arbeitnow": (
        {
            "source_id": f"CASE WHEN l_returnflag <> 'N' THEN source_id ELSE {_PART_ID} END",
            "location": "coalesce(city, '')",
            "city": "city",
            "region": "coalesce(region, 'Deutschland')",
            "contract_type": "contract_type || ', vollzeit'",
            "posted_at": "CASE WHEN l_linestatus = 'F' THEN posted_at ELSE posted_at - INTERVAL 2 HOUR END",
            **_TAGS,
        },
        "true",
    ),
    "jooble": (
        {
            "source_id": _PART_ID,
            "city": "location",
            "salary_present": "salary_min IS NOT NULL",
            "category_tag": "NULL::VARCHAR",
            "category_label": "NULL::VARCHAR",
        },
        "true",
    ),
    "jsearch": (
        {
            "location": "nullif(trim(coalesce(city, '') || ' ' || CASE WHEN l_quantity < 40 THEN 'DE' ELSE '' END), '')",
            "city": "city",
            "state": "state",
            "region": "region",
            "salary_min": "CASE WHEN l_linestatus <> 'F' THEN salary_min END",
            "salary_max": "salary_max",
            "salary_present": "(l_linestatus <> 'F' AND salary_min IS NOT NULL) OR salary_max IS NOT NULL",
            "currency": "currency",
        },
        "l_linenumber <> 3 AND p_size <> 7",
    ),
    "muse": (
        {
            "source_id": "l_partkey::VARCHAR",
            "location_segments": "coalesce(split_part(location, ',', 1), '')",
            "city": "split_part(location, ',', 1)",
        },
        "l_partkey <> 0",
    ),
    "remotive": (
        {
            "source_id": "(l_partkey + 1)::VARCHAR",
            "location": f"""CASE state WHEN 'EUROPE' THEN 'Europe only' WHEN 'ASIA' THEN '  ' WHEN 'AFRICA' THEN 'Neuss'
                            ELSE {_PLACE} END""",
            "region": "'Remote'",
            "salary_present": "salary_min IS NOT NULL",
        },
        f"state IN ('EUROPE', 'ASIA', 'AFRICA') OR {_PLACE} IS NULL",
    ),
    "jobicy": (
        {
            "source_id": "(l_partkey + 1)::VARCHAR",
            "location": f"CASE WHEN l_quantity < 30 THEN 'Anywhere' ELSE {_PLACE} END",
            "region": "'Remote'",
            "salary_min": "salary_min",
            "salary_max": "salary_max",
            "salary_present": _PAID,
        },
        f"l_quantity < 30 OR state = 'EUROPE' OR {_PLACE} IS NULL",
    ),
    "remoteok": (
        {
            "location": f"CASE WHEN l_quantity < 20 THEN 'Remote' ELSE coalesce({_PLACE}, 'Remote') END",
            "region": "'Remote'",
            "currency": "'USD'",
            "contract_type": "NULL::VARCHAR",
            "url": "CASE WHEN l_returnflag = 'A' THEN url ELSE url || '?src=list' END",
            **_TAGS,
        },
        "l_linenumber <> 3",
    ),
}
for _source, (_columns, _where) in _ADAPTERS.items():
    _fields = ", ".join(f"{expression} AS {name}" for name, expression in (_ADAPTED | _columns).items())
    _add(f"adapt_{_source}", f"SELECT {_fields} FROM bronze WHERE {_where}")

# ---- jobs --------------------------------------------------------------------------------------

_add(
    "incremental_run",
    """SELECT source, strftime(fetched_at, '%Y') AS year, count(*) AS postings, count(DISTINCT job_id) AS job_ids FROM (
  SELECT source, fetched_at, source || ':' || source_id AS job_id FROM bronze WHERE source = 'adzuna' AND l_linenumber <> 3
  UNION ALL SELECT source, fetched_at, 'muse:' || l_partkey FROM bronze WHERE source = 'muse' AND l_partkey <> 0
  UNION ALL SELECT source, fetched_at, 'remotive:' || (l_partkey + 1) FROM bronze WHERE source = 'remotive'
     AND (state IN ('EUROPE', 'ASIA', 'AFRICA') OR city || ', ' || state IS NULL))
GROUP BY 1, 2""",
)

_RERUN_TIES = "fetched_at DESC, posted_at DESC NULLS LAST, title, company NULLS FIRST"
_add(
    "backfill",
    f"""SELECT run_day, count(*) AS postings, count(DISTINCT dedup_key) AS keys FROM (
{_first(
    "(" + _first("(" + _first("bronze", "run_day, source, source_id", _RERUN_TIES) + ")", f"run_day, {_BATCH}", _RERUN_TIES) + ")",
    "run_day, dedup_key",
    f"source_priority DESC, {_RERUN_TIES}",
)})
WHERE run_day BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' GROUP BY run_day""",
)
_add(
    "bronze_day",
    """SELECT job_id, source, source_id, title, fetched_at, '01' AS month, '01' AS day, 'a_m' AS category, run_day
FROM bronze WHERE run_day = DATE '1997-01-01' AND search_category < 'M'""",
)



def _day_chain(table: str) -> str:
    """The three rules of a day, with the jobs' own ties."""
    latest = _first(table, "run_day, source, source_id", _RERUN_TIES)
    batch = _first(f"({latest})", f"run_day, {_BATCH}", _RERUN_TIES)
    return _first(f"({batch})", "run_day, dedup_key", f"source_priority DESC, {_RERUN_TIES}")


_add(
    "backfill_rows",
    f"""SELECT run_day, source, dedup_key, title, company, fetched_at, posted_at, coalesce(category_label, category_tag) AS category
FROM ({_day_chain("bronze")}) WHERE run_day IN (DATE '1996-01-01', DATE '1998-01-01')""",
)

# Nine boards: which rows a board sends, and what its adapter makes of them.
_SEGMENTS = {
    "adzuna": "CASE WHEN l_quantity < 30 THEN ['Welt', state, city] ELSE ['Welt', state, 'Kreis', city] END",
    "bundesagentur": "list_filter([state, 'Welt', city], lambda x: x IS NOT NULL)",
    "muse": "list_filter([nullif(split_part(location, ',', 1), '')], lambda x: x IS NOT NULL)",
}
_SENT_COLUMNS = "source_id title company city state region location posted_at".split()


def _sent(source: str) -> str:
    columns, kept = _ADAPTERS[source]
    picked = ", ".join(f"{(_ADAPTED | columns)[name]} AS {name}" for name in _SENT_COLUMNS)
    mine = f"l_linenumber = {BOARD_LINES[source]}" if source in BOARD_LINES else f"source = '{source}'"
    return f"""SELECT '{source}' AS source, search_category, run_day, l_linenumber + 10 * (l_partkey % 5) AS page,
       run_day + to_hours(CAST(l_linenumber AS BIGINT)) AS fetched_at, {picked}, {kept} AS kept,
       {_SEGMENTS.get(source, "[]::VARCHAR[]")} AS segments FROM bronze WHERE {mine} AND l_linenumber <> 5"""


_SENT = f""", sent AS MATERIALIZED (
SELECT s.*, b.source_priority, {_KEY} AS dedup_key, coalesce(source_id, '') <> '' AND coalesce(title, '') <> '' AS valid
FROM ({" UNION ALL BY NAME ".join(f"({_sent(source)})" for source in _ADAPTERS)}) s JOIN boards b USING (source))"""
_RUNS = f"""{_SENT}, run_days AS MATERIALIZED (
SELECT *, source || ':' || source_id AS job, lower(trim(title)) AS title_norm, {_COMPANY} AS company_norm
FROM ({_day_chain("(SELECT * FROM sent WHERE kept AND valid)")}))"""
_add("incremental_silver", f"{_RUNS} SELECT run_day, source, dedup_key, title, company, fetched_at, posted_at FROM run_days")
_KEY_2 = "title_norm, coalesce(nullif(company_norm, ''), 'unbekannt')"
_add(
    "incremental_gold",
    f"""{_RUNS}, newest AS MATERIALIZED ({_first("run_days", "job", _RERUN_TIES)}), facts AS MATERIALIZED ({_first("newest", _KEY_2, _RERUN_TIES)})
SELECT source, title, fetched_at, posted_at,
       CASE WHEN company_norm <> '' THEN md5(company_norm)
            WHEN EXISTS (FROM facts blank WHERE blank.company = '') THEN md5('unbekannt') END AS company_id,
       md5(concat_ws('|', coalesce(city, nullif(segments[3], ''), nullif(segments[2], ''), location, 'unbekannt'),
                     coalesce(state, nullif(segments[2], ''), region, 'unbekannt'), coalesce(region, 'Deutschland'))) AS location_id
FROM facts""",
)

_units = _values([(source, unit) for source, (_, unit) in TOTALS.items()])
_add(
    "ingest_report",
    f"""{_SENT} SELECT b.source, coalesce(pages, 0)::BIGINT + CASE WHEN b.source = '{EMPTY_PAGE[0]}' THEN searches ELSE 0 END AS pages,
       coalesce(loaded, 0)::BIGINT AS loaded, coalesce(valid, 0)::BIGINT AS valid,
       coalesce(loaded - valid, 0)::BIGINT AS quarantined, b.source = '{ABORT[0]}' AS aborted,
       CASE WHEN b.source = '{ABORT[0]}' THEN '{ABORT[2]}' END AS abort_reason, coalesce(categories, '') AS categories,
       coalesce(hits, 0)::BIGINT AS hits, coalesce(estimated, 0)::BIGINT AS estimated, coalesce(cut, 0)::BIGINT AS cut
FROM boards b LEFT JOIN (
  SELECT source, sum(pages) AS pages, sum(hits) AS hits, sum(loaded) AS loaded, sum(valid) AS valid, count(*) AS searches,
         string_agg(search_category, '|' ORDER BY search_category) AS categories, sum(total) AS estimated,
         count(*) FILTER (WHERE hits < total) AS cut
  FROM (SELECT source, search_category, count(*) AS pages, sum(hits) AS hits, sum(loaded) AS loaded, sum(valid) AS valid,
               max(CASE WHEN unit IS NULL THEN hits WHEN search_category = '{PROMISED[0]}' THEN {PROMISED[1]} * unit ELSE hits * unit END) AS total
        FROM (SELECT source, search_category, run_day, page, count(*) AS hits, count(*) FILTER (WHERE kept) AS loaded,
                     count(*) FILTER (WHERE kept AND valid) AS valid
              FROM sent WHERE source <> 'remoteok' GROUP BY ALL)
        LEFT JOIN (VALUES {_units}) AS u(source, unit) USING (source)
        GROUP BY source, search_category)
  GROUP BY source) r USING (source)""",
)

# Silver rows of which some are seen again a year later.
_OBSERVED = """SELECT * FROM silver UNION ALL BY NAME
SELECT * REPLACE (CAST(run_day + INTERVAL 1 YEAR AS DATE) AS run_day, fetched_at + INTERVAL 1 YEAR AS fetched_at,
       CASE WHEN source_id LIKE '%-1' THEN salary_mid + 1 ELSE salary_mid END AS salary_mid,
       CASE WHEN source_id LIKE '%-4' THEN title || ' II' ELSE title END AS title,
       CASE WHEN source_id LIKE '%-4' THEN title_norm || ' ii' ELSE title_norm END AS title_norm)
FROM silver WHERE source_id LIKE '%-1' OR source_id LIKE '%-4'"""
_SEEN = _first(f"({_first(f'({_OBSERVED})', 'job_id', _RERUN_TIES)})", _KEY_2, _RERUN_TIES)
_add(
    "upkeep_fact_jobs",
    f"""SELECT job_id, source, title, salary_mid, fetched_at, array_to_string(skills, '|') AS skills,
       CASE WHEN company_norm <> '' THEN md5(company_norm)
            WHEN max(CASE WHEN company = '' THEN 1 ELSE 0 END) OVER () = 1 THEN md5('unbekannt') END AS company_id,
       md5(concat_ws('|', coalesce(city, 'unbekannt'), coalesce(state, 'unbekannt'), coalesce(region, 'Deutschland'))) AS location_id
FROM ({_SEEN})""",
)
_add("upkeep_fact_skills", f"SELECT job_id, skill, count(*) AS weight FROM (SELECT job_id, unnest(skills) AS skill FROM ({_SEEN})) GROUP BY ALL")
_add(
    "upkeep_dimensions",
    f"""WITH seen AS ({_SEEN})
SELECT 'company' AS kind, md5(key) AS id, min(company) AS name
FROM (SELECT company, coalesce(nullif(company_norm, ''), 'unbekannt') AS key FROM seen WHERE company IS NOT NULL) GROUP BY key
UNION ALL
SELECT DISTINCT 'place', md5(name), name
FROM (SELECT concat_ws('|', coalesce(city, 'unbekannt'), coalesce(state, 'unbekannt'), coalesce(region, 'Deutschland')) AS name FROM seen)""".replace("WITH seen AS", ", seen AS"),
)

# ---- stores ------------------------------------------------------------------------------------

_add(
    "quarantine_rows",
    f"""SELECT source, 'schema_verletzung' AS reason, errors, search_category, page::INT AS page, fetched_at,
       '{{"source_id":"' || source_id || '"' || CASE WHEN title IS NULL THEN '' ELSE ',"title":"' || title || '"' END || '}}' AS record,
       '{POSTINGS_AS_OF[5:7]}' AS month
FROM judged WHERE errors <> ''""",
)
_add(
    "silver_days_present",
    f"""SELECT CAST(d AS DATE) AS day, d IN (SELECT run_day FROM ({_OBSERVED})) AS present
FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2005-01-01', INTERVAL 1 YEAR)) AS d)""",
)
_add(
    "run_status",
    f"""SELECT status.*, CASE WHEN r.source IS NOT NULL THEN TIMESTAMP '{AS_OF} 06:00:00' END AS run_at,
       CASE WHEN status.source = 'jooble' AND r.source IS NOT NULL THEN used END AS used,
       CASE WHEN status.source = 'jooble' AND r.source IS NOT NULL THEN round(used / 10, 1) END AS percent
FROM status LEFT JOIN report r USING (source), (SELECT count(*) AS used FROM orders WHERE o_orderstatus = 'P')""",
)
_STORED = "SELECT username, job_id, array_to_string(status, '|') AS status, nullif(snapshot, '') AS snapshot, updated_at FROM stored"
_add("activity_stored", _STORED)
_add("activity_of_user", _STORED + " WHERE username = 'user_7'")
_TAXONOMY = """SELECT p_name || ' ' || p_partkey AS canonical, CASE WHEN p_size > 30 THEN p_type ELSE 'sonstige' END AS category,
       CASE WHEN p_size % 2 = 0 THEN lower(p_brand) || '|' || p_type ELSE '' END AS synonyms FROM part"""
_add("load_taxonomy", _TAXONOMY)
_add("canonical_skills", f"SELECT canonical FROM ({_TAXONOMY})")
_add(
    "next_keysets",
    """SELECT b.source, strftime(posted_at, '%Y-%m-%dT%H:%M:%S.%f') || '|' || job_id AS token
FROM boards b LEFT JOIN (
  SELECT source, posted_at, job_id, row_number() OVER (PARTITION BY source ORDER BY posted_at DESC NULLS LAST, job_id DESC) AS rn
  FROM fact_jobs) f ON f.source = b.source AND rn = 60""",
)
