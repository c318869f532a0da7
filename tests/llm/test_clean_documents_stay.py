"""Quality rules and language ID leave clean documents alone."""

import random

import duckdb

from stellwerk.llm import sql
from stellwerk.llm.language_id import fit, identify, known_language
from stellwerk.llm.quality_rules import clean_documents, judge

ARTICLE = " ".join(f"word{i}" for i in range(800))
OTHER = " ".join(f"term{i}" for i in range(300))


def test_one_line_articles(spark):
    rows = [
        (1, ARTICLE + " as the privacy policy says"),
        (2, ARTICLE + " Home > Shop > Cart > " + OTHER),
        (3, ARTICLE + " wow!! really!! yes"),
        (4, ARTICLE + " a | b | c " + OTHER),
        (5, ARTICLE + "\nplease read our privacy policy\nHome > Shop > Cart > Pay\nwow!! really!!\na | b | c"),
        (6, "\n".join(["please read our privacy policy and accept all cookies now"] * 3 + [f"unique line {i} of terms of use" for i in range(20)])),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id: r.text for r in clean_documents(docs).collect()}
    assert kept == {i: t for i, t in rows[:4]} | {5: ARTICLE}
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    mine = sorted(tuple(r) for r in judge(docs).select("row.doc_id", *[f"quality.{c}" for c in columns]).collect())
    found = con.sql(sql.QUALITY)
    order = [found.columns.index(c) for c in ["doc_id", *columns]]
    assert mine == sorted(tuple(r[i] for i in order) for r in found.fetchall())


def test_every_language_is_learned(spark):
    """250 made-up languages, each of words of its own letters."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for lang in range(250):
        own = rng.sample(letters, 6)
        for i in range(14):
            text = " ".join("".join(rng.choice(own) for _ in range(rng.randrange(3, 9))) for _ in range(40))
            rows.append((lang * 14 + i, text, f"l{lang:03d}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(docs)
    assert len(model.languages) == 250
    right = identify(docs, model).where("lang_pred = row.lang").count()
    assert right > 0.9 * len(rows)


def test_without_labels_documents_with_letters_stay(spark):
    rows = [(1, "ein Satz", None), (2, "123 ...", None), (3, None, None), (4, "日本語", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in known_language(docs).collect()) == [1, 4]
    assert known_language(docs).columns == docs.columns
