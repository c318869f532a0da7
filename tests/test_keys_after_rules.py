"""The keys are hashes: the rules that do not look at them do not shuffle them."""

import datetime as dt

from pyspark.sql import functions as F

from stellwerk.operators import dedup
from stellwerk.plans.scratch import kept_by
from stellwerk.sources import lake
from stellwerk.sources.unify import with_keys

T0 = dt.datetime(2025, 6, 1, 10, 0)


def postings(spark, n):
    """Repeated ids, titles and companies on three boards, some of them null."""
    data = [
        (("muse", "adzuna", "jobicy")[i % 3], None if i % 41 == 0 else str(i % 70), None if i % 37 == 0 else f"T{i % 9}", None if i % 5 == 0 else f"C{i % 4}", T0 + dt.timedelta(minutes=40 * (i % 6)), i % 2, i)
        for i in range(n)
    ]
    return spark.createDataFrame(data, "source string, source_id string, title string, company string, fetched_at timestamp, day int, posted_at int")


def test_rules_give_the_same_rows_when_keys_are_made_after_them(spark):
    rows = postings(spark, 700)
    for ties in (None, [F.asc("posted_at")]):
        wanted = dedup.dedup_bronze(with_keys(rows), ("day",), ties)
        for given in (rows, with_keys(rows)):
            if ties is None and given is rows:
                continue  # hashes that settle ties are those of the columns there are
            got = dedup.dedup_bronze(given, ("day",), ties, with_keys)
            assert sorted(map(str, got.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_first_two_rules_shuffle_no_keys(spark, tmp_path):
    rows = postings(spark, 300)
    rows.write.parquet(str(tmp_path / "b"))
    stored = lake.located(spark.read.parquet(str(tmp_path / "b")))
    found = dedup.kept_positions(stored, dedup.bronze_rules(("day",), [F.asc("posted_at")], with_keys))
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    made = [i for i, line in enumerate(plan) if "sha2(" in line]
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(day" in line]
    # From the last rule down to the first: the key is made between the shuffles of the last two rules.
    assert len(shuffles) == 3 and len(made) == 1 and shuffles[0] < made[0] < shuffles[1]
    with kept_by(stored, dedup.bronze_rules(("day",), [F.asc("posted_at")], with_keys)) as got:
        wanted = dedup.dedup_bronze(with_keys(rows), ("day",), [F.asc("posted_at")]).select(*rows.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
