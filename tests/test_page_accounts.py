"""Accounts of pages: empty pages, silent and aborted boards, estimated totals; batch and stream."""

import json

from stellwerk.operators.validate import ingest_report, run_totals, source_status, status_summary
from stellwerk.plans import jobs
from stellwerk.sources import lake, landing
from stellwerk.sources.adapters import ADAPTERS
from stellwerk.sources.unify import filter_categories
from stellwerk.streaming.incremental import run_incremental

AT = "2025-06-02T06:00:00Z"
BODIES = {
    "adzuna": lambda items, total: {"results": items, "count": total},
    "bundesagentur": lambda items, total: {"maxErgebnisse": str(total), "stellenangebote": items},
    "arbeitnow": lambda items, total: {"data": items, "meta": {"total": total, "x": 1}},
    "jooble": lambda items, total: {"totalCount": total, "jobs": items},
    "jsearch": lambda items, total: {"data": {"jobs": items}},
    "muse": lambda items, total: {"results": items, "page_count": total},
    "remotive": lambda items, total: {"jobs": items},
    "jobicy": lambda items, total: {"jobs": items},
    "remoteok": lambda items, total: items,
}


def line(source, items, page=1, total=None, category="de"):
    return json.dumps({"search_category": category, "page": page, "fetched_at": AT, "body": BODIES[source](items, total)})


def stop(page, reason, category="de"):
    return json.dumps({"search_category": category, "page": page, "fetched_at": AT, "abort_reason": reason})


def land(tmp_path, **lines):
    paths = {}
    for source, texts in lines.items():
        folder = tmp_path / "in" / source
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(texts) + "\n" if texts else "")
        paths[source] = str(folder)
    return paths


def test_every_board_tells_its_total(spark, tmp_path):
    paths = land(tmp_path, **{s: [line(s, [{"id": "1"}, {"id": "2"}], total=7)] for s in BODIES})
    totals = {}
    for source, path in paths.items():
        rows = landing.read_landing(spark, source, path, pages=True)
        (info,) = [r.page_info for r in rows.where("page_info IS NOT NULL").collect()]
        assert info.hits == 2 and rows.where("page_info IS NULL").count() == 2
        totals[source] = info.total
    assert totals == dict.fromkeys(BODIES, 2) | dict.fromkeys(("adzuna", "bundesagentur", "arbeitnow", "jooble"), 7) | {"muse": 140}


def run_paths(tmp_path):
    job = lambda i: {"id": str(i), "title": f"T{i}"}
    return land(
        tmp_path,
        adzuna=[
            line("adzuna", [job(1), {"title": "no id"}, "broken"], 1, 5),
            line("adzuna", [], 2, 5),
            line("adzuna", [job(2)], 1, 1, "ml"),
            "{kaputt",
        ],
        jooble=[line("jooble", [job(3)], 1, 40), stop(2, "Quota erschoepft"), stop(3, "spaeter", "ml")],
        remotive=[line("remotive", [{"id": 4, "title": "x", "candidate_required_location": "Mars"}])],
        muse=[],
        jobicy=[line("jobicy", [])],
        jsearch=[stop(1, "Zugriff verweigert")],
    )


def as_rows(report):
    names = ["pages", "hits", "loaded", "valid", "quarantined", "aborted", "abort_reason", "categories", "estimated", "cut"]
    return {r.source: tuple(r[n] for n in names) for r in report.collect()}


EXPECTED = {
    "adzuna": (3, 4, 4, 2, 2, False, None, "de|ml", 6, 1),
    "jooble": (1, 1, 1, 1, 0, True, "Quota erschoepft", "de|ml", 40, 1),
    "remotive": (1, 1, 0, 0, 0, False, None, "de", 1, 0),
    "muse": (0, 0, 0, 0, 0, False, None, "", 0, 0),
    "jobicy": (1, 0, 0, 0, 0, False, None, "de", 0, 0),
    "jsearch": (0, 0, 0, 0, 0, True, "Zugriff verweigert", "de", 0, 0),
}


def test_batch_report(spark, tmp_path):
    root = str(tmp_path / "lake")
    report = jobs.ingest(spark, run_paths(tmp_path), root, "r1", "2025-06-02")
    assert as_rows(report) == EXPECTED
    assert tuple(run_totals(report).first()) == (5, 3, 2)
    assert tuple(status_summary(source_status(report)).first()) == (2, 1)
    assert lake.read_bronze(spark, f"{root}/{jobs.BRONZE}").count() == 3
    assert lake.read_quarantine(spark, f"{root}/{jobs.QUARANTINE}").count() == 2
    # A repeated run replaces its accounts, another one adds its own.
    assert as_rows(jobs.ingest(spark, {k: v for k, v in run_paths(tmp_path).items()}, root, "r2", "2025-06-02"))["jobicy"][0] == 2
    again = lake.read_pages(spark, f"{root}/{jobs.PAGES}", "r1")
    assert as_rows(ingest_report(again, list(EXPECTED))) == EXPECTED


def test_stream_keeps_the_same_accounts(spark, tmp_path):
    root = str(tmp_path / "stream")
    run_incremental(spark, run_paths(tmp_path), root, calendar_end="2025-12-31")
    assert as_rows(ingest_report(lake.read_pages(spark, f"{root}/{jobs.PAGES}"), list(EXPECTED))) == EXPECTED


def test_a_category_takes_its_pages_and_unreadable_lines_only(spark, tmp_path):
    rows = filter_categories(ADAPTERS["adzuna"](landing.read_landing(spark, "adzuna", run_paths(tmp_path)["adzuna"], pages=True)), ["ml"])
    kept = sorted((str(r.search_category), r.page_info is not None, str(r.source_id)) for r in rows.collect())
    assert kept == [("None", False, "None"), ("ml", False, "2"), ("ml", True, "None")]
