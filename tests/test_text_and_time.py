"""Text and timestamp functions against plain Python."""

import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F

from stellwerk.functions import moments
from stellwerk.functions.text import is_relevant_location, like_anywhere, norm_text


def python_norm(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", plain.lower().strip())


SAMPLES = [
    None,
    "",
    "  Senior\tData\n Engineer  ",
    "Müller & Söhne GmbH",
    "ﬁnance ½ Ⅳ ™",
    "İstanbul ŁÓDŹ",
    "a\u00a0b\u2003c\u001cd",
    "हिन्दी ภาษาไทย",
    "Ａ１ ﷺ",
    "e\u0301\u0327 \u1e9b\u0323",
    "日本語 ガ",
]


def test_norm_text_equals_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", norm_text(F.col("t")).alias("n")).collect()}
    assert got == {i: python_norm(t) for i, t in enumerate(SAMPLES)}


def test_norm_text_equals_python_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for row in df.select("text", norm_text(F.col("text")).alias("n")).collect():
        assert row.n == python_norm(row.text)


def test_like_anywhere_keeps_wildcards_and_escapes_backslash(spark):
    df = spark.createDataFrame([("Data_Engineer",), ("DataXEngineer",), ("C:\\Data",)], "t string")

    def hits(text):
        return {r.t for r in df.where(like_anywhere(F.col("t"), text)).collect()}

    assert hits("DATA_ENG") == {"Data_Engineer", "DataXEngineer"}
    assert hits("c:\\d") == {"C:\\Data"}
    assert hits("a%neer") == {"Data_Engineer", "DataXEngineer"}


def test_relevant_location(spark):
    cases = {None: True, "  ": True, "Germany": True, "Neuss": True, "USA only": False, "EMEA": True}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.ok for r in df.select("t", is_relevant_location(F.col("t")).alias("ok")).collect()}
    assert got == cases


def _parsed(spark, function, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    text = F.date_format(function(F.col("t")), "yyyy-MM-dd HH:mm:ss")
    return {r.t: r.m for r in df.select("t", text.alias("m")).collect()}


def test_iso_dates(spark):
    got = _parsed(
        spark,
        moments.parse_iso,
        ["2025-06-01T12:00:00Z", "2025-06-01T12:00:00+02:00", "2025-06-01", "2025", "gestern", "", None, "2025-13-01"],
    )
    assert got["2025-06-01T12:00:00Z"] == "2025-06-01 12:00:00"
    assert got["2025-06-01T12:00:00+02:00"] == "2025-06-01 10:00:00"
    assert got["2025-06-01"] == "2025-06-01 00:00:00"
    assert [got[k] for k in ("2025", "gestern", "", None, "2025-13-01")] == [None] * 5


def test_epoch_or_iso(spark):
    got = _parsed(spark, moments.parse_iso_or_epoch, ["1717243200", "0", "2024-06-01T00:00:00", "99999999999999999", "x"])
    assert got["1717243200"] == "2024-06-01 12:00:00"
    assert got["2024-06-01T00:00:00"] == "2024-06-01 00:00:00"
    assert got["0"] is None and got["x"] is None and got["99999999999999999"] is None


def test_berlin_time_with_wrong_zone(spark):
    got = _parsed(spark, moments.parse_mislabelled_berlin, ["2025-06-01T12:00:00Z", "2025-01-01T12:00:00+0100", "nie"])
    assert got == {"2025-06-01T12:00:00Z": "2025-06-01 10:00:00", "2025-01-01T12:00:00+0100": "2025-01-01 11:00:00", "nie": None}


def test_day_or_second(spark):
    got = _parsed(spark, moments.parse_day_or_second, ["2025-06-01T12:30:00.0000000", "2025-06-01", "01.06.2025"])
    assert got == {"2025-06-01T12:30:00.0000000": "2025-06-01 12:30:00", "2025-06-01": "2025-06-01 00:00:00", "01.06.2025": None}


def test_trailing_start(spark):
    row = spark.range(1).select(moments.trailing_start("2024-03-01", 30).alias("d"), moments.month_start("2024-03-15").alias("m")).first()
    assert (row.d, row.m) == (dt.date(2024, 1, 31), dt.date(2024, 3, 1))
