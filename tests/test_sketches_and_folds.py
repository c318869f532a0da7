"""Salary sketches per place and activity folds in blocks, against plain versions."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from stellwerk.operators import activity as act
from stellwerk.operators import metrics


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(5)
    jobs = [(f"l{rng.randrange(60)}", round(rng.gauss(60000, 9000), rng.randrange(3))) for _ in range(20_000)] + [("l1", None), ("l61", None)]
    dims = [(f"l{i}", f"c{i % 7}" if i % 11 else "", f"s{i % 3}" if i else None) for i in range(62)]
    gold = {
        "fact_jobs": spark.createDataFrame(jobs, "location_id string, salary_mid double"),
        "dim_location": spark.createDataFrame(dims, "location_id string, city string, state string"),
    }
    groups = {"city": {}, "state": {}}
    for at, salary in jobs:
        _, city, state = dims[int(at[1:])]
        for name, value in (("city", city), ("state", state)):
            if salary is not None and value:
                groups[name].setdefault(value, []).append(salary)
    return gold, groups


@pytest.mark.parametrize("group", ["city", "state"])
def test_sketches_stay_within_rank_error(places, group):
    gold, groups = places
    rows = {r.grp: r for r in metrics.salary_distribution(gold, group, accuracy=100).collect()}
    assert rows.keys() == groups[group].keys()
    for name, values in groups[group].items():
        values.sort()
        row = rows[name]
        assert row.n == len(values) and row.salary_mid == pytest.approx(statistics.fmean(values))
        for q, found in ((0.25, row.salary_p25), (0.5, row.salary_median), (0.75, row.salary_p75)):
            assert abs(values.index(found) + 1 - q * len(values)) <= 2 * len(values) / 100 + 1
    # Sketches that hold all values are exact.
    for row in metrics.salary_distribution(gold, group).collect():
        values = groups[group][row.grp]
        assert abs(values.index(row.salary_median) + 1 - 0.5 * len(values)) <= 1


@pytest.mark.parametrize("group", ["city", "state"])
def test_exact_form(places, group):
    gold, groups = places
    for row in metrics.salary_distribution_exact(gold, group).collect():
        low, median, high = statistics.quantiles(groups[group][row.grp], n=4, method="inclusive")
        assert (row.salary_p25, row.salary_median, row.salary_p75) == pytest.approx((low, median, high))
        assert row.n == len(groups[group][row.grp]) and row.salary_mid == pytest.approx(statistics.fmean(groups[group][row.grp]))



def test_places_are_joined_above_the_aggregate(places):
    gold, _ = places
    plan = metrics.salary_distribution(gold, "city")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("kll_merge_agg_double") < plan.index("Join") < plan.index("kll_sketch_agg_double")


def plain_fold(events):
    state, since = {"seen": False, "saved": False, "applied": False}, None
    for ts, _, kind in sorted(events):
        if kind == act.REMOVE:
            state, since = dict.fromkeys(state, False), None
            continue
        since = since or ts
        if kind == act.MARK_SEEN:
            state["seen"] = True
        elif kind == act.TOGGLE_SAVED:
            state["saved"] = not state["saved"]
        elif kind == act.SET_APPLIED or not state["applied"]:
            state["saved"] = state["applied"] = True
        else:
            state["applied"] = False
    names = {"seen": "gesehen", "saved": "gespeichert", "applied": "beworben"}
    return since and ([names[s] for s in ("seen", "saved", "applied") if state[s]], since)


@pytest.mark.parametrize("block_rows", [1, 7, 4096])
def test_one_key_with_a_third_of_all_actions(spark, block_rows):
    rng = random.Random(7)
    kinds = [act.MARK_SEEN, act.TOGGLE_SAVED, act.SET_APPLIED, act.TOGGLE_APPLIED]
    start, rows, groups = dt.datetime(2025, 1, 1), [], {}
    for i in range(3000):
        key = ("hot", "j") if i % 3 == 0 else (f"u{rng.randrange(40)}", f"j{rng.randrange(3)}")
        kind = act.REMOVE if rng.random() < 0.02 else rng.choice(kinds)
        event = (start + dt.timedelta(minutes=rng.randrange(2000)), i, kind)
        rows.append((*key, *event))
        groups.setdefault(key, []).append(event)
    df = spark.createDataFrame(rows, "username string, job_id string, ts timestamp_ntz, seq bigint, action string")
    found = {(r.username, r.job_id): (r.status, r.saved_at) for r in act.apply_actions(df.repartition(5), block_rows).collect()}
    expected = {k: plain_fold(v) for k, v in groups.items()}
    assert found == {k: v for k, v in expected.items() if v}


def test_all_actions_of_one_key(spark):
    """100,000 actions of one key, in blocks of 4,096."""
    df = spark.range(100_000).select(
        F.lit("u").alias("username"), F.lit("j").alias("job_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") == 99_000, F.lit(act.REMOVE)).otherwise(F.lit(act.TOGGLE_SAVED)).alias("action"),
    )
    (row,) = act.apply_actions(df).withColumn("since", F.unix_seconds("saved_at")).collect()
    assert (row.status, row.since) == (["gespeichert"], 99_001)
