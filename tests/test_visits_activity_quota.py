"""Visit log, user activity and quota."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stellwerk.operators import activity as act
from stellwerk.operators import quota, visits
from stellwerk.sources.activity_store import read_activity, write_activity
from stellwerk.sources.visit_log import read_visit_log

LOG = """2025-06-10 09:00:00 CEST | 1.1.1.1 | Deutschland | Berlin | Netz AG | GET /a?x=1 | 200 | Mozilla (iPhone) | https://www.x.de:8080/p
2025-06-10 10:00:00 CEST | 1.1.1.1 | lokal | GET /a?x=2 | 200 | Mozilla Windows | -
2025-06-04 10:00:00 CEST | 2.2.2.2 | unbekannt | POST /api/v1/health | 500 | - |
2025-06-03 10:00:00 CEST | 3.3.3.3 | lokal | GET /static/a.js | 404 | curl | nur text
2025-05-31 10:00:00 CEST | 3.3.3.3 | lokal | /nur-pfad | 404 | Googlebot/2.1 Mobile | //www.www.y.de/z
zu | kurz
"""


def log(spark, tmp_path):
    path = tmp_path / "visits.txt"
    path.write_text(LOG)
    return read_visit_log(spark, str(path))


def test_parse_and_totals(spark, tmp_path):
    rows = log(spark, tmp_path)
    assert rows.count() == 5
    first = rows.where("path = '/a?x=1'").first()
    assert (first.geo, first.method, first.status) == ("Deutschland | Berlin | Netz AG", "GET", "200")
    assert tuple(visits.visit_totals(rows, "2025-06-10").first()) == (5, 3, 2, 3, 4)


def test_days_are_filled(spark, tmp_path):
    rows = visits.visits_per_day(log(spark, tmp_path), "2025-06-10").collect()
    assert len(rows) == 30 and rows[-1].n == 2 and rows[-2].n == 0 and sum(r.n for r in rows) == 5
    assert rows[0].day == dt.date(2025, 5, 12)


def test_rankings(spark, tmp_path):
    rows = visits.visits_top(log(spark, tmp_path)).collect()
    got = {(r.dimension, r.name): r.n for r in rows}
    assert got[("path", "/a")] == 2 and got[("city", "?")] == 4 and got[("country", "lokal")] == 3
    assert {n for d, n in got if d == "referrer"} == {"x.de:8080", "Direkt", "nur text", "y.de"}
    assert {n for d, n in got if d == "device"} == {"Mobile", "Windows", "Unbekannt", "Sonstige", "Bot/Crawler"}


def test_search_and_exclusion(spark, tmp_path):
    rows = log(spark, tmp_path)
    assert visits.search_visits(rows, " NETZ ").count() == 1
    assert visits.search_visits(rows, " ").count() == 5
    assert visits.exclude_paths(rows).count() == 3
    assert visits.visits_newest_first(rows).first().time.startswith("2025-06-10 10")


def fold(actions):
    """Plain fold of one key: what the application does step by step."""
    entry = None
    for ts, _, action in sorted(actions):
        status = set(entry[0]) if entry else set()
        saved_at = entry[1] if entry else ts
        if action == "remove":
            entry = None
            continue
        if action == "mark_seen":
            status |= {"gesehen"}
        elif action == "toggle_saved":
            status ^= {"gespeichert"}
        elif action == "set_applied" or "beworben" not in status:
            status |= {"gespeichert", "beworben"}
        else:
            status -= {"beworben"}
        entry = (status, saved_at)
    return entry


def test_actions_equal_a_plain_fold_even_for_one_hot_key(spark):
    pick = random.Random(3)
    kinds = ["mark_seen", "toggle_saved", "set_applied", "toggle_applied", "remove"]
    rows = []
    for seq in range(6000):
        hot = pick.random() < 0.6
        user, job = ("hot", "hot") if hot else (f"user{pick.randint(0, 20)}", f"j{pick.randint(0, 30)}")
        kind = pick.choices(kinds, [3, 5, 1, 4, 0.02 if hot else 1])[0]
        rows.append((user, job, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=pick.randint(0, 3000)), seq, kind))
    df = spark.createDataFrame(rows, "username string, job_id string, ts timestamp, seq bigint, action string")
    groups = {}
    for user, job, ts, seq, kind in rows:
        groups.setdefault((user, job), []).append((ts, seq, kind))
    want = {k: v for k, v in ((k, fold(v)) for k, v in groups.items()) if v}
    got = {
        (r.username, r.job_id): (set(r.status), r.saved)
        for r in act.apply_actions(df).withColumn("saved", F.date_format("saved_at", "yyyy-MM-dd HH:mm")).collect()
    }
    assert got == {k: (s, t.strftime("%Y-%m-%d %H:%M")) for k, (s, t) in want.items()}


def test_upsert(spark):
    kind = "username string, job_id string, status array<string>, snapshot string"
    base = spark.createDataFrame(
        [("u", "a", ["gesehen"], '{"t":1}', dt.datetime(2025, 1, 1)), ("u", "b", [], None, dt.datetime(2025, 1, 1))],
        kind + ", updated_at timestamp",
    )
    updates = spark.createDataFrame(
        [("u", "a", ["beworben", "x"], None, 1), ("u", "c", ["gesehen"], '{"t":2}', 2), ("u", "c", ["gespeichert"], "{}", 3)],
        kind + ", seq int",
    )
    got = {r.job_id: (r.status, r.snapshot) for r in act.upsert_activity(base, updates, "2025-02-01 00:00:00").collect()}
    assert got == {"a": (["beworben"], '{"t":1}'), "b": ([], None), "c": (["gespeichert"], '{"t":2}')}
    again = act.upsert_activity(act.upsert_activity(base, updates, "2025-02-01"), updates, "2025-02-01")
    assert {r.job_id: (r.status, r.snapshot) for r in again.collect()} == got


def test_merge(spark):
    kind = "username string, job_id string, status array<string>, snapshot string"
    local = spark.createDataFrame([("u", "a", ["gesehen", "beworben"], None), ("u", "l", ["gesehen"], "L")], kind)
    server = spark.createDataFrame([("u", "a", ["gespeichert"], "S"), ("u", "s", ["gesehen", "beworben"], "T")], kind)
    got = {r.job_id: (r.status, r.snapshot) for r in act.merge_activity(local, server).collect()}
    assert got == {
        "a": (["beworben", "gespeichert", "gesehen"], "S"),
        "l": (["gesehen"], "L"),
        "s": (["gesehen", "beworben"], "T"),
    }


def test_store_roundtrip_and_names(spark, tmp_path):
    kind = "username string, job_id string, status array<string>, snapshot string, updated_at timestamp"
    rows = spark.createDataFrame(
        [("anna_1", "a", ["gesehen"], "{}", dt.datetime(2025, 1, 1)), ("X", "b", [], None, dt.datetime(2025, 1, 1))], kind
    )
    write_activity(rows, str(tmp_path / "activity"))
    assert [r.status for r in read_activity(spark, str(tmp_path / "activity"), "anna_1").collect()] == [["gesehen"]]
    assert [r.username for r in act.valid_username(rows).collect()] == ["anna_1"]


def test_quota(spark):
    log = spark.createDataFrame(
        [("jooble", dt.datetime(2025, 1, 1), 300), ("jooble", dt.datetime(2025, 6, 1), 100), ("jsearch", dt.datetime(2025, 5, 31), 190),
         ("jsearch", dt.datetime(2025, 6, 2), 33)],
        "api string, ts timestamp, calls int",
    )
    limits = spark.createDataFrame([("jooble", 500, False), ("jsearch", 200, True), ("neu", 10, True)], "api string, quota_limit int, monthly boolean")
    rows = {r.api: r for r in quota.quota_flags(quota.quota_usage(log, limits, "2025-06-15")).collect()}
    assert (rows["jooble"].used, rows["jooble"].percent, rows["jooble"].warn, rows["jooble"].exhausted) == (400, 80.0, True, False)
    assert (rows["jsearch"].used, rows["jsearch"].percent, rows["jsearch"].reset_date) == (33, 16.5, dt.date(2025, 6, 1))
    assert rows["neu"].used == 0
