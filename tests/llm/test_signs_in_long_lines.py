"""Signs of navigation and boilerplate are looked for in lines of any length, by a plain count."""

import re

import duckdb

from stellwerk.llm import sql
from stellwerk.llm.quality_rules import BOILERPLATE, clean_documents, judge

ARTICLE = " ".join(f"word{i}" for i in range(200))
OTHER = " ".join(f"term{i}" for i in range(150))
NOTICE = "please accept all cookies and read our privacy policy before you go on with this page"


def fails(line):
    n = line.count("!!") // 2 + len(re.findall(r" \| ", line)) // 2 + len(re.findall(" [>»] ", line)) // 2
    n += bool(re.search(r"\|[ \t-\r]*\Z", line)) + len(re.findall("|".join(sorted(BOILERPLATE)), line.lower()))
    return n > 0 and n * 200 >= len(line)


def test_long_lines_of_signs_fail(spark):
    lines = [
        " and ".join([NOTICE] * 9),
        "Home > Shop > Cart > Pay > Help > Terms and many other words of a trail that goes on " * 4,
        " | ".join(f"entry {i} of the long menu" for i in range(30)),
        "buy now!! cheap!! " * 20,
        OTHER + " as the privacy policy says",
        OTHER + " a | b | c",
        "short privacy policy",
        "x !!!! y",
        "a |",
        "entry of the menu that is long " * 7 + "|",
        "a | | b | c",
        " » a » b > c",
    ]
    expected = [fails(line) for line in lines]
    assert expected[:6] == [True] * 4 + [False] * 2
    rows = [(i, ARTICLE + "\n" + line) for i, line in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id: r.text for r in clean_documents(docs).collect()}
    long = {i for i, line in enumerate(lines) if fails(line) and len(line.replace(" ", "")) > len(ARTICLE.replace(" ", ""))}
    assert kept == {i: ARTICLE if expected[i] else text for i, text in rows if i not in long}
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    found = {r[0]: r[-1] for r in con.sql(f"SELECT doc_id, kept FROM ({sql.QUALITY})").fetchall()}
    assert found == {r[0]: r[1] for r in judge(docs).select("row.doc_id", "quality.kept").collect()}
