"""Skill extraction against a brute-force search with one pattern per skill."""

import random
import re

from pyspark.sql import functions as F

from stellwerk.operators import skills as sk
from stellwerk.operators.skills import STANDARD_TAXONOMY, Skill


def brute_force(text, taxonomy):
    found = []
    for skill in taxonomy:
        body = "|".join(re.escape(v) for v in (skill.canonical, *skill.synonyms))
        if text and re.search(rf"(?<![A-Za-z0-9_+#])(?:{body})(?![A-Za-z0-9_+#])", text, re.IGNORECASE):
            if skill.canonical not in found:
                found.append(skill.canonical)
    return found


def extracted(spark, texts, taxonomy):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", sk.extract_skills(F.col("t"), taxonomy).alias("s")).collect()
    return [r.s for r in sorted(rows, key=lambda r: r.i)]


def test_examples(spark):
    texts = [
        "Wir suchen Python, SQL, Apache Spark und AWS.",
        "Bachelorabschluss und rsync sind willkommen.",
        "Erfahrung mit Power BI und Tableau.",
        "",
        None,
        "R in Rücksprache, R-Programmierung, R+",
        "aws kinesis / gcp bigquery / t-sql",
        "Linux\u212aafka \u212aAFKA  A\u0130RFLOW ba\u017fh",
    ]
    got = extracted(spark, texts, STANDARD_TAXONOMY)
    assert got == [brute_force(t, STANDARD_TAXONOMY) for t in texts]
    assert set(got[0]) == {"Python", "SQL", "Spark", "AWS"}
    assert "R" not in got[1] and {"PowerBI", "Tableau"} <= set(got[2]) and got[3] == [] and got[4] == []


def test_random_texts_with_overlapping_taxonomy(spark):
    taxonomy = [
        Skill("C++", "x", ("cpp",)),
        Skill("C", "x", ()),
        Skill("Data", "x", ("data lake",)),
        Skill("Lake", "x", ("lake house",)),
        Skill("Data Lake House", "x", ()),
        Skill("House", "x", ("house of data",)),
        Skill("Of", "x", ("of data",)),
        Skill("Data", "again", ("datum",)),
        Skill("Tausch", "x", ("cpp",)),
        Skill("a.b", "x", ("a|b", "über")),
    ]
    pick = random.Random(7)
    words = ["data", "lake", "house", "of", "C", "c++", "cpp", "C#", "datum", "a.b", "axb", "a|b", "Über", "x", "_data", "lake,"]
    texts = [pick.choice([" ", "-", "/", "  "]).join(pick.choices(words, k=pick.randint(0, 12))) for _ in range(400)]
    assert extracted(spark, texts, taxonomy) == [brute_force(t, taxonomy) for t in texts]


def test_random_texts_with_standard_taxonomy(spark):
    pick = random.Random(11)
    vocabulary = [v for s in STANDARD_TAXONOMY for v in (s.canonical, *s.synonyms)] + ["und", "mit", "+", "#", "(", "x_"]
    texts = ["".join(pick.choice(vocabulary) + pick.choice([" ", ",", "", "/", "\n"]) for _ in range(15)) for _ in range(300)]
    assert extracted(spark, texts, STANDARD_TAXONOMY) == [brute_force(t, STANDARD_TAXONOMY) for t in texts]


def test_standard_taxonomy_needs_one_scan():
    assert len(STANDARD_TAXONOMY) == 47
    assert len(sk._scan_groups(STANDARD_TAXONOMY)) == 1


def test_category_and_names(spark):
    frame = sk.taxonomy_frame(spark)
    words = spark.createDataFrame([("python",), ("DBT",), ("cobol",)], "skill string")
    got = {r.skill: r.skill_category for r in sk.skill_category(words, frame).collect()}
    assert got == {"python": "sprache", "DBT": "transformation", "cobol": None}
    assert {"Python", "Kafka", "Terraform"} <= {r.canonical for r in sk.canonical_skills(frame).collect()}


def test_load_and_merge(spark, tmp_path):
    path = tmp_path / "skills.json"
    path.write_text('{"canonical": "Rust", "synonyms": ["rustlang"]}\n{"canonical": "PYTHON", "category": "x"}\n')
    loaded = sk.load_taxonomy(spark, str(path))
    assert {(r.canonical, r.category, tuple(r.synonyms)) for r in loaded.collect()} == {
        ("Rust", "sonstige", ("rustlang",)),
        ("PYTHON", "x", ()),
    }
    second = loaded.select(F.lit(0).alias("position"), "*").unionByName(
        spark.createDataFrame([(1, "rust", "later", ["r"])], "position int, canonical string, category string, synonyms array<string>")
    )
    merged = sk.merge_taxonomies(sk.taxonomy_frame(spark), second)
    extra = merged.where("origin = 'secondary'").collect()
    assert [(r.canonical, r.category) for r in extra] == [("Rust", "sonstige")]
    assert merged.count() == 48
    assert sk.collect_taxonomy(second)[-1] == Skill("rust", "later", ("r",))
