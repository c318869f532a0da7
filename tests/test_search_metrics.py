"""Search, paging and metrics against brute force on gold tables of the given data."""

import statistics

import pytest
from pyspark.sql import functions as F

from contract import fixtures as fx
from stellwerk.operators import metrics
from stellwerk.operators.search import MAX_PAGE, JobsFilter, next_keyset, parse_keyset, search, unseen_only


@pytest.fixture(scope="module")
def gold(spark, sf_dir):
    return {name: table.cache() for name, table in fx.gold(spark, sf_dir).items()}


def test_pages_concatenate_to_the_full_order(gold):
    dated = gold["fact_jobs"].where("posted_at is not null")
    tables = dict(gold, fact_jobs=dated)
    token, seen = None, []
    while True:
        page = search(tables, JobsFilter(after=token, limit=150))
        seen += [r.job_id for r in page.collect()]
        token = next_keyset(page, 150)
        if token is None:
            break
    wanted = [r.job_id for r in dated.orderBy(F.desc("posted_at"), F.desc("job_id")).collect()]
    assert seen == wanted and len(seen) > 300


def test_undated_postings_come_last_and_end_paging(gold):
    undated = dict(gold, fact_jobs=gold["fact_jobs"].where("posted_at is null"))
    page = search(undated, JobsFilter(limit=5))
    assert page.count() == 5 and next_keyset(page, 5) is None
    assert search(undated, JobsFilter(after="2000-01-01|f")).isEmpty()


def test_limit_and_keyset_are_checked(gold):
    # The search interface refuses a page size it would have to change.
    for limit in (0, MAX_PAGE + 1):
        with pytest.raises(ValueError):
            search(gold, JobsFilter(limit=limit))
    assert search(gold, JobsFilter(limit=MAX_PAGE)).count() == MAX_PAGE
    assert parse_keyset("2025-01-01T00:00:00 02:00|a|b") == ("2025-01-01T00:00:00+02:00", "a|b")
    with pytest.raises(ValueError):
        parse_keyset("2025-01-01")


def test_page_is_cut_before_the_dimension_join(gold):
    plan = search(gold, JobsFilter(category="promo"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("GlobalLimit")


def test_unseen(spark, gold):
    some = [r.job_id for r in gold["fact_jobs"].limit(3).collect()]
    activity = spark.createDataFrame(
        [("u", some[0], ["gesehen"]), ("u", some[1], ["gespeichert"]), ("v", some[2], ["gesehen"])],
        "username string, job_id string, status array<string>",
    )
    left = {r.job_id for r in unseen_only(gold["fact_jobs"], activity, "u").collect()}
    assert some[0] not in left and {some[1], some[2]} <= left


def interpolated(values, q):
    values = sorted(values)
    p = q * (len(values) - 1)
    low = int(p)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (p - low)


@pytest.mark.parametrize("width", [0.5, 100.0, 1e9])
def test_exact_quantiles_equal_brute_force(spark, width):
    rows = [("hot", float((i * 7919) % 1000) / 4) for i in range(3000)] + [("one", 5.0), ("two", -3.5), ("two", 8.0)]
    rows += [("same", 42.0)] * 100 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.grp: (r.n, r.q) for r in metrics.exact_quantiles(df, "g", "v", (0.0, 0.25, 0.5, 0.75, 1.0), width).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g][0] == len(values)
        assert got[g][1] == pytest.approx([interpolated(values, q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])


def test_approximate_quartiles_stay_within_rank_error(gold):
    salaries = {}
    for row in gold["fact_jobs"].where("salary_mid is not null").select("source", "salary_mid").collect():
        salaries.setdefault(row.source, []).append(row.salary_mid)
    for row in metrics.salary_distribution(gold, "source", accuracy=100).collect():
        values = sorted(salaries[row.grp])
        assert row.n == len(values) and row.salary_mid == pytest.approx(statistics.fmean(values))
        for q, found in ((0.25, row.salary_p25), (0.5, row.salary_median), (0.75, row.salary_p75)):
            assert abs(values.index(found) + 1 - q * len(values)) <= len(values) / 100 + 1


def test_distribution_rejects_other_groups(gold):
    with pytest.raises(ValueError):
        metrics.salary_distribution(gold, "title")


def test_empty_group_is_dropped_after_the_cut(spark):
    jobs = spark.createDataFrame(
        [("", 1.0)] * 3 + [(f"c{i:02d}", float(i)) for i in range(30)], "category string, salary_mid double"
    )
    rows = metrics.salary_distribution({"fact_jobs": jobs}, "category").collect()
    assert len(rows) == 24 and rows[0].grp == "c00"


def test_spread_floors_at_zero(spark):
    df = spark.createDataFrame(
        [("a", 3.0, 2.0, 1.0), ("b", None, None, 4.0)],
        "grp string, salary_p25 double, salary_median double, salary_p75 double",
    )
    assert [tuple(r) for r in metrics.salary_spread(df).orderBy("grp").collect()] == [("a", 2.0, 0.0, 3.0), ("b", 0.0, 4.0, 0.0)]


def test_filter_ranking_without_text_keeps_all(spark):
    df = spark.createDataFrame([("Berlin",), ("Bonn",)], "city string")
    assert metrics.filter_ranking(df, "city", "").count() == 2
    assert metrics.filter_ranking(df, "city", "BON").count() == 1
