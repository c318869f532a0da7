"""Values whose JSON type decides whether they count as given."""

import json

import pytest

from stellwerk.sources.adapters import ADAPTERS

# value, counts as given, as text
VALUES = [("0", True, "0"), ("false", True, "false"), (0, False, None), (0.0, False, None), ([], False, None), ({}, False, None), ("", False, None), (None, False, None), (False, False, None), (7, True, "7"), ("x", True, "x"), ([1], True, "[1]")]


def adapted(spark, source, items):
    rows = [(source, "de", None, 1, json.dumps(i), True) for i in items]
    df = spark.createDataFrame(rows, "source string, search_category string, fetched_at timestamp, page int, record string, intact boolean")
    return ADAPTERS[source](df)


@pytest.mark.parametrize("source,title", [("muse", "name"), ("remotive", "title"), ("jobicy", "jobTitle"), ("remoteok", "position")])
def test_only_given_ids_stay(spark, source, title):
    found = {r.title: r.source_id for r in adapted(spark, source, [{"id": v, title: str(i)} for i, (v, _, _) in enumerate(VALUES)]).collect()}
    assert found == {str(i): text for i, (_, given, text) in enumerate(VALUES) if given}


@pytest.mark.parametrize("source,title", [("jooble", "title"), ("arbeitnow", "title")])
def test_missing_ids_become_empty(spark, source, title):
    found = {r.title: r.source_id for r in adapted(spark, source, [{"id": v, title: f"t{i}"} for i, (v, _, _) in enumerate(VALUES)]).collect()}
    assert found == {f"t{i}": text if given else "" for i, (_, given, text) in enumerate(VALUES)}


@pytest.mark.parametrize("source,identity,low", [("adzuna", "id", "salary_min"), ("jobicy", "id", "salaryMin"), ("jsearch", "job_id", "job_min_salary")])
def test_salaries(spark, source, identity, low):
    items = [{identity: f"i{i}", "job_title": "t", low: v} for i, (v, _, _) in enumerate(VALUES)]
    found = {r.source_id: (r.salary_present, r.salary_min) for r in adapted(spark, source, items).collect()}
    for i, (value, given, _) in enumerate(VALUES):
        present, number = found[f"i{i}"]
        assert present == given, value
        if isinstance(value, (int, float)) and value:
            assert number == value
    text_zero = found["i0"][1]
    assert text_zero is None if source == "adzuna" else text_zero == 0.0


def test_records_are_parsed_once(spark):
    for source in ADAPTERS:
        plan = adapted(spark, source, [{"id": 1}])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, source
