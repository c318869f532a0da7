"""Quotient filters against plain counters, collocations against counting in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stellwerk.llm import phrases
from stellwerk.llm import quotient_filter as qf
from stellwerk.llm.phrases import collocations

SCHEMA = "doc_id bigint, text string, lang string"


@pytest.mark.parametrize("n_ids,length", [(1, 2), (2, 3), (5, 2), (1000, 3), (1 << 21, 3), (1 << 30, 2), (1 << 33, 3), (1 << 42, 3), (1 << 60, 2)])
def test_keys_and_filters_lose_nothing(n_ids, length):
    rng = np.random.default_rng(length)
    pool = [rng.integers(0, n_ids, 40) for _ in range(length)]
    pick = rng.integers(0, 40, 3000)
    ids = [p[pick] for p in pool]
    half = qf.half_bits(n_ids, length)
    keys = qf.packed(ids, n_ids)
    assert all((a == b).all() for a, b in zip(qf.unpacked(keys, n_ids, length), ids))
    mixed = qf.permuted(keys, half)
    assert all((a == b).all() for a, b in zip(qf.restored(mixed, half), keys))
    assert all(int(lane.max()) < 1 << half for lane in mixed)

    weights = rng.integers(1, 1 << 40, 3000)
    plain = Counter()
    for *key, w in zip(*[x.tolist() for x in mixed], weights.tolist()):
        plain[tuple(key)] += w
    filters = []
    for part in np.array_split(np.arange(3000), 4):
        each, counts = qf.counted((mixed[0][part], mixed[1][part]), half, weights[part])
        filters.append(qf.encode(each, counts, (half, half)))
        again, same = qf.decode(filters[-1], (half, half))
        assert (again[0] == each[0]).all() and (again[1] == each[1]).all() and (same == counts).all()
    (left, right), counts = qf.merged(filters, (half, half))
    assert list(zip(zip(left.tolist(), right.tolist()), counts.tolist())) == sorted(plain.items())


def test_filters_are_compact_and_may_be_empty():
    none = qf.encode((np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64), (20, 20))
    assert qf.decode(none, (20, 20))[1].size == 0 and qf.merged([none, none], (20, 20))[1].size == 0
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(7), np.zeros(5000, np.uint64)
    full = qf.encode(keys, np.ones(5000, np.int64), (20, 8))
    assert sum(len(x) for x in full[2:]) < 5000 * 4.5  # an entry: one byte and a half of bits, remainders, count


def test_every_key_is_permuted_to_another_one():
    for half in (1, 2, 5):
        keys = np.divmod(np.arange(1 << 2 * half, dtype=np.uint64), np.uint64(1 << half))
        left, right = qf.permuted(keys, half)
        assert len(set(zip(left.tolist(), right.tolist()))) == 1 << 2 * half


def plain(rows, least=10, covered=50, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", small):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for size in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        longer = Counter()
        for p, a in counts.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        found = []
        for p, a in counts.items():
            if len(p) == 1 or a < least or (len(p) == 2 and longer[p] and 100 * longer[p] >= covered * a):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def got(spark, rows, **more):
    found = collocations(spark.createDataFrame(rows, SCHEMA), **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in found.collect())


def sample(rng, n):
    common = ["the", "New", "york", "a", "b", "c", "ÄÖ", "naïve", "x-y", " z", "日本"]
    out = []
    for i in range(n):
        ws = [rng.choice(common) if rng.random() < 0.8 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(120))]
        out.append((i, "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "; ", "  "]) for w in ws), rng.choice(["en", "en", "de", None, "und"])))
    return out


def test_against_counting(spark):
    rows = sample(random.Random(8), 300)
    expected = plain(rows)
    assert len(expected) > 200 and got(spark, rows) == expected
    assert got(spark, rows, least=3, covered=80, most=7) == plain(rows, 3, 80, 7)


def test_small_slices_filters_and_shards(spark, monkeypatch):
    """Many slices, filters handed on early, several shards; one task's worker sees the changed sizes."""
    monkeypatch.setattr(phrases, "SHARD", 50)
    rows = sample(random.Random(9), 200)
    assert got(spark, rows) == plain(rows)


def test_counter_hands_on_in_parts(monkeypatch):
    monkeypatch.setattr(phrases, "ENTRIES", 64)
    rng = np.random.default_rng(1)
    counter, found, plain_counts = phrases._Counter(2, 50, 2), [], Counter()
    for _ in range(30):
        ids = rng.integers(-1, 50, 100)
        found += list(counter.add(ids))
        plain_counts.update((a, b) for a, b in zip(ids.tolist(), ids[1:].tolist()) if a >= 0 and b >= 0)
    found += list(counter.flush())
    half, total = qf.half_bits(50, 2), Counter()
    assert len(found) > 8
    for length, shard, *f in found:
        (left, right), counts = qf.decode(qf.Filter(*f), (half - 2, half))
        ids = qf.unpacked(qf.restored((left | np.uint64(shard << (half - 2)), right), half), 50, 2)
        for a, b, c in zip(*[x.tolist() for x in ids], counts.tolist()):
            total[a, b] += c
    assert total == plain_counts


def test_odd_rows(spark):
    odd = [(None, "a b a b " * 30, None), (1, None, "en"), (1, "", "en"), (2, " .,\n ", None), (3, "p q " * 20, "en"), (3, "p q " * 20, "en")]
    long = [(4, "alpha beta gamma " * 200_000, "de")]
    assert got(spark, odd) == plain(odd) and got(spark, odd + long) == plain(odd + long)
    beside = [(i, t, "en") for i, t in enumerate(["x", "", None, "y", "", "x y", "y", ".", "x"] * 12)]
    assert got(spark, beside) == plain(beside) != []
    assert got(spark, []) == [] and got(spark, [(1, "a b", "en")]) == []
    clash = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 AS slice", "2 AS w1", "'x' AS words", "3 AS n", "4 AS `a b`")
    assert sorted(map(tuple, collocations(clash).collect())) == plain(odd)
