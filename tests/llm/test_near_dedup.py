"""Near duplicates against all pairs, hot groups, odd rows."""

import random
import re

from stellwerk.llm.components import connected_components
from stellwerk.llm.near_dedup import near_duplicates, without_near_duplicates

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, width):
    ws = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return frozenset()
    if len(ws) < width:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))


def brute(rows, width, percent=80):
    sets = {i: shingle_set(t, width) for i, t in rows}
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = sorted((root(a), root(b)))
                home[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(spark, rows, width=4):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, width).collect()}


def test_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    for i, (_, text) in enumerate(rows[:40]):
        ws = text.split(" ")
        for n in range(3):
            for _ in range(max(1, len(ws) // 60)):
                ws[rng.randrange(len(ws))] = f"w{rng.randrange(1000)}"
            rows.append((10_000 + 10 * i + n, " ".join(ws)))
    assert got(spark, rows) == brute(rows, 4)


def test_chain_and_large_group_of_variants(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        ws = list(base)
        for _ in range(3):
            ws[rng.randrange(len(ws))] = f"x{i}-{rng.randrange(9)}"
        rows.append((i, " ".join(ws)))
    # A chain in which only neighbours are similar.
    for i in range(30):
        rows.append((1000 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 120))))
    rows.extend((2000 + i, "the same short text") for i in range(300))
    result = got(spark, rows)
    assert result == brute(rows, 4)
    assert result[1029][1] == 1000 and result[2299][1] == 2000


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A  b\nC"), (7, "a b c"), (None, "a b c"), (8, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS component", "'y' AS key", "1 AS a")
    result = sorted(near_duplicates(docs, 4).select("doc_id", "n_shingles", "component_id", "kept").collect(), key=str)
    by_id = {r.doc_id: r for r in result}
    assert len(result) == len(rows)
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5, 8)] == [1, 2, 3, 4, 4, 8]
    assert by_id[1].n_shingles == 0 and by_id[4].kept and not by_id[5].kept
    assert by_id[None].component_id is None and by_id[6].component_id is None
    assert near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    def text(name, *changed):
        return " ".join(f"x{i}" if i in changed else f"{name}{i}" for i in range(100))

    rows = [(None, text(f"n{i}-")) for i in range(60)] + [(7, text("s")), (7, text("t")), (8, text("t", 99)), (9, text("n0-", 99)), (10, text("n1-", 99))]
    rows += [(None, text("n2-")), (None, text("n3-", 99)), (11, text("p")), (11, text("p"))]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, `c 0` int")
    kept = {r["c 0"] for r in without_near_duplicates(docs).collect()}
    # 9, 10 and the two last null rows are copies of null rows, 8 of one row of id 7, one row of id 11 of the other.
    assert kept - {2, 3, 65, 66, 67, 68} == set(range(62)) - {2, 3}
    assert [len(kept & pair) for pair in ({2, 65}, {3, 66}, {67, 68})] == [1, 1, 1]
    result = near_duplicates(docs, 5).collect()
    assert len(result) == len(rows) and sum(r.kept for r in result) == len(kept)
    assert sorted((r.doc_id, r.component_id) for r in result if r.doc_id in (7, 8)) == [(7, 7), (7, 7), (8, 7)]


def test_components_of_a_path(spark):
    n = 50
    edges = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)], "a bigint, b bigint")
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.where("a < 0")).count() == 0
