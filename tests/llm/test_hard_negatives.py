"""Hard negatives against all pairs in Python; ties, hot vectors, odd rows, several blocks and chunks."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stellwerk.llm import hard_negatives as module
from stellwerk.llm.hard_negatives import Lists, hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"
LAST = (1 << 63) - 1


def plain(rows, k=5, m=5, low=80, high=100):
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, q, label) in enumerate(good):
        if a is None or a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), LAST if i is None else i, n) for n, (i, v, _) in enumerate(good) if n != at)
        for p, pid, n in [s for s in scored if good[s[2]][2] == label][:k]:
            fits = [s for s in scored if good[s[2]][2] != label and low * -p <= 100 * -s[0] <= high * -p][:m]
            out += [(a, pid, r, i, -p, -s) for r, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def got(spark, rows, **more):
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(LAST if x is None else x for x in r) for r in found.collect())


def vectors(rng, n, d, labels=4):
    return [(i, [np.float32(rng.gauss(0, 0.3)).item() for _ in range(d)], rng.randrange(labels)) for i in range(n)]


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = vectors(rng, 700, 12)
    expected = plain(rows)
    assert len(expected) > 50 and got(spark, rows) == expected


def test_several_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", (64, 256))
    monkeypatch.setattr(module, "CHUNK", 2)
    rows = vectors(random.Random(4), 500, 4)
    assert got(spark, rows, positives=3, negatives=7, low=50) == plain(rows, 3, 7, 50)


def test_hot_vector_ties_and_repeated_rows(spark):
    """A third of all rows are one vector, under all labels; ids decide."""
    rng = random.Random(6)
    hot = [0.5, -0.25, 0.125]
    rows = vectors(rng, 200, 3) + [(1000 + i, hot, i % 4) for i in range(120)]
    assert got(spark, rows) == plain(rows)
    twice = rows + [r for r in rows if r[0] in (100, 105, 1000, 1003)]
    assert got(spark, twice) == plain(twice)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (400, [1.0, inf], 1), (500, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (None, [1.0, 0.9], 2)]
    few = [(0, [1.0, 1.0], 1), (1, [1.0], 1), (2, [], 2), (3, [0.9, 0.9], 2), (4, [1.0, 1.0], 2), (600, [0.0, 0.0], 1), (700, [-1.0, -1.0], 1)]
    assert got(spark, odd + few) == plain(odd + few)
    assert got(spark, []) == [] and got(spark, odd) == []
    assert got(spark, [(0, [1.0], 1)]) == [] and got(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == plain([(0, [], 1), (1, [], 1), (2, [], 2)])
    large = [(0, [1e7, -1e7], 1), (1, [1e7, 1e7], 1), (2, [2e7, -1e7], 1), (3, [1e7, -1.2e7], 2)]
    assert got(spark, large) == plain(large)
    clash = spark.createDataFrame(few, SCHEMA).selectExpr("*", "1 AS number", "2 AS block", "'x' AS `a b`", "3 AS wanted", "4 AS id")
    assert sorted(map(tuple, hard_negatives(clash, F.col("vec_id") % 100 == 0).collect())) == plain(few)


def test_walk_ends_at_the_threshold():
    """With one heavy component the first rows of its list decide, and the others are never met."""
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (4000, 6))
    x[:, 0] = rng.permutation(4000) * 10
    q = np.array([100, 1, -1, 0, 2, 1])
    rows, scores = Lists(x).walk(q, np.ones(4000, bool), [-(1 << 60)], [1 << 60], 5)
    exact = np.sort(x @ q)[::-1]
    assert len(rows) < 1000 and (np.sort(scores)[::-1][:5] == exact[:5]).all()
    low, high = int(exact[900]), int(exact[800])
    rows, scores = Lists(x).walk(q, np.ones(4000, bool), [low], [high], 5)
    assert len(rows) < 3000 and np.isin(exact[800:805], scores).all()
