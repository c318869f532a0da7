"""Mixing against its SQL and against a plain version in Python; hot sources, repeated rows, odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from stellwerk.llm.mixing import mix
from stellwerk.llm.numbering import numbered

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain(rows, weights=(5, 2, 1), share=1.5, most=2):
    """Sorted (doc_id, size, source, target, taken), by sorting each source's documents."""
    docs = [(i, t or "", s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, _, s, n in docs:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        unit = (share * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit > most * sizes[s]}
        if not above:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in above}
        free -= above
    out = []
    for s in names:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest = target[s] - whole * sizes[s]
        mine = sorted((int(hashlib.md5(f"{'' if i is None else i}|{t}".encode()).hexdigest()[:15], 16), n, i) for i, t, x, n in docs if x == s)
        for _, n, i in mine:
            extra = rest >= n or (rest > 0 and n <= 2 * rest)
            out.append((str(i), n, str(s), round(target[s], 6), n * (whole + extra)))
            rest -= n
    return sorted(out)


def got(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)
    return sorted((str(r.doc_id), r.size, str(r.source), round(r.target, 6), r.taken) for r in mix(docs, **more).collect())


def test_against_sorting(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(60))), rng.choice(["hot", "hot", "hot", "b", "c", None, "ü", "Z"])) for i in range(800)]
    rows += [(1000, "one two", "tiny"), (1001, None, "silent"), (1002, " \t", "silent"), (None, "no id here", "b"), (None, "no id here", "b")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, weights=(1, 7), share=0.3, most=1) == plain(rows, (1, 7), 0.3, 1)


def test_near_target_nested_and_repeatable(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = {r.doc_id: r for r in mix(docs).collect()}
    again = {r.doc_id: r for r in mix(docs.repartition(7)).collect()}
    assert first == again and len(first) == docs.count()
    taken, longest, target = defaultdict(int), defaultdict(int), {}
    for r in first.values():
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in first.values()))
    less = {r.doc_id: r.copies for r in mix(docs, share=1.2).collect()}
    smaller = {r.source for r in mix(docs, share=1.2).collect() if r.target <= target[r.source]}
    assert all(less[i] <= r.copies for i, r in first.items() if r.source in smaller)


def test_equal_rows_share_one_hash(spark):
    """300 equal rows without an id: the budget ends among them."""
    rows = [(None, "same text again", "a")] * 300 + [(i, "x y z", "b") for i in range(100)]
    assert got(spark, rows) == plain(rows)


def test_empty_table_and_further_columns(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", None, "s", 3)], SCHEMA).selectExpr("*", "1 AS size", "2 AS hash", "3 AS number", "4 AS target", "5 AS bucket")
    assert [tuple(r) for r in mix(docs).collect()] == [(1, "s", 2, 2, 3.0, 2, 4)]


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) AS x").repartition(9)
    assert sorted(r.number for r in numbered(rows, "n").collect()) == list(range(1000))
    by_order = sorted((r.number, r.x) for r in numbered(rows, "n", [rows["x"].asc()]).collect())
    assert [x for _, x in by_order] == sorted(str(i) for i in range(1000))
    assert numbered(rows.limit(0), "n").count() == 0
