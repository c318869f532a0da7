"""Text normalisation over the whole of Unicode, and filters that pass it."""

import sys
import unicodedata

from pyspark.sql import functions as F

from stellwerk.functions.text import norm_text
from stellwerk.sources.unify import with_keys
from tests.test_text_and_time import python_norm


def test_all_characters(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    rows = [(i, "".join(map(chr, points[i : i + 40])) + " x") for i in range(0, len(points), 40)]
    rows += [(-1, "각힣가 한국어 데이터 ﷺ ㍿ e\u0301 \U0001F100x")]
    texts = dict(rows)
    # Lower case is the engine's own; compared is what stands before it.
    df = spark.createDataFrame(rows, "i int, t string").select("i", norm_text(F.col("t")).alias("n"))
    wrong = [i for i, n in df.collect() if n != python_norm(texts[i])]
    lowered = {i for i in wrong if any(c.lower() != c for c in unicodedata.normalize("NFKD", texts[i]))}
    assert set(wrong) == lowered and len(wrong) < 12


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([("a", "1", "T", "C"), ("b", "2", "Ü", "é")], "source string, source_id string, title string, company string").write.parquet(path)
    rows = with_keys(spark.read.parquet(path)).where("source = 'b'")
    assert rows._jdf.queryExecution().optimizedPlan().deterministic()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,b)" in plan.split("PushedFilters: ")[1].split("]")[0]
    assert rows.count() == 1
