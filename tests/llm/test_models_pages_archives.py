"""Learned operators on held-out rows, page texts, archives, the pipeline."""

import gzip
import hashlib

from stellwerk.llm import html_extraction, language_id, toxicity, warc
from stellwerk.llm.columnar import new_folder
from stellwerk.llm.registry import op8_warc


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model).selectExpr("row.doc_id AS i", "row.lang AS lang", "lang_pred", "score").collect()
    held = {r.i: r.out for r in docs.select(docs.doc_id.alias("i"), language_id.held_out(docs.doc_id).alias("out")).collect()}
    out = [r for r in rows if held[r.i]]
    assert 150 < len(out) < 350 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !? \n", "x"), (4, "a" * 300_000, "x"), (None, "the of and", "x")], "doc_id bigint, text string, lang_pred string")
    found = {r.row.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[4].lang_pred != "und" and found[4].row.lang_pred == "x"
    assert language_id.identify(odd.limit(0), model).count() == 0
    nothing = odd.selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in language_id.identify(nothing, language_id.fit(nothing)).collect()} == {"und"}


def test_toxicity_ranks_unseen_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = toxicity.toxicity(docs.join(labels.where("doc_id % 4 = 0").select("doc_id"), "doc_id"), model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    bad, good = [r for r in rows if r.label == 1], [r for r in rows if r.label == 0]
    assert sum(r.toxic for r in bad) >= 0.8 * len(bad) and sum(r.toxic for r in good) <= 0.03 * len(good)
    assert all(abs(sum(r.grade_probabilities) - 1) < 1e-9 and abs(sum(k * p for k, p in enumerate(r.grade_probabilities)) - r.severity) < 1e-9 for r in rows)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "!!! ???"), (2, "x" * 200_000)], "doc_id bigint, text string")
    assert toxicity.toxicity(odd, model).count() == 4
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.severity for r in toxicity.toxicity(odd, empty).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a = "</p><article>";</script></head><body>
<header><h2>Site name here</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href='/b>c'>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site</div>
<article><h1>Title&nbsp;of &lt;it&gt;</h1><p>First  <b>para</b>graph<br>with a break &eacute; and enough words to count as text.
<p>Second <!-- hidden --> paragraph has a number of words too.</p><div class="ad">Buy now</div><form>Name <input></form>
<section class="comments"><p>I was here</p></section></article><footer>&copy; all</footer></body></html>"""


def test_page_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (3, None, ""), (4, "u", "<p>cut off <b>he"), (5, "u", "<nav>only</nav>"), (6, "u", "<p>" + "long text " * 100_000 + "<a hre"), (None, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS name")
    found = html_extraction.extract_text(pages).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    wanted = "Title of <it>\n\nFirst paragraph with a break é and enough words to count as text.\n\nSecond paragraph has a number of words too."
    assert by_id[1].text == wanted == by_id[None].text
    assert [by_id[i].text for i in (2, 3, 4, 5)] == ["", "", "cut off he", ""] and by_id[6].n_chars == 10 * 100_000 - 1
    assert html_extraction.extract_text(pages.limit(0)).count() == 0


def test_highest_run_is_the_best_of_all_runs():
    scores = {"p": -0.5, "li": -4.0, "a": -6.0}
    page = "a b<li>c</li><p>d e f g h i</p><p>j k<li>l</li><a>m</a>"
    parts = list(html_extraction.tokens(page))
    value = [scores.get(v, html_extraction.UNSEEN) if k else len(v.split()) for k, v, _ in parts]
    best = max(((sum(value[i:j]), -i, j) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)), key=lambda x: x[0])
    words = " ".join(v for k, v, _ in parts[-best[1] : best[2]] if not k).split()
    assert html_extraction.main_text(page, scores).split() == words


def test_archives(spark, tmp_path):
    long = "<p>" + "same page " * 50
    rows = [(1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (3, None, None), (4, "http://b/4", ""), (5, "http://b/5", "é" * 10), (6, "http://b/6", "é" * 10)]
    rows += [(7, "http://c/7", "x\r\n\r\nWARC/1.1\r\n" * 3000), (None, "http://c", long), (1, "http://a/1", long), (0, "http://a/0", long + "!")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = op8_warc(spark, str(tmp_path)).collect()
    wanted = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((k for k, _, h in rows if h == html and k is not None), default=None) if len(data) >= 100 else i
        again = i is not None and first != i
        wanted.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    spark.read.parquet(f"{tmp_path}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op8_warc(spark, f"{tmp_path}/none").count() == 0


def test_archives_of_others_and_pushed_predicates(spark, tmp_path):
    warc.use_warc(spark)
    records = [warc.record_bytes({"record_id": f"<urn:{i}>", "type": t, "target_uri": f"http://x/{i}", "payload": b"body %d" % i}) for i, t in enumerate(["response", "warcinfo", "response"])]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))  # without member lengths
    (tmp_path / "own.warc.gz").write_bytes(b"".join(warc.gzip_member(r, 6) for r in records))
    path = str(tmp_path)
    assert all(gzip.decompress(warc.gzip_member(r, 1)) == r for r in records)
    everything = spark.read.format("warc").load(path)
    assert sorted(bytes(r.payload) for r in everything.where("type = 'response'").collect()) == [b"body 0"] * 3 + [b"body 2"] * 3
    assert everything.where("target_uri LIKE 'http://x/1%'").count() == 3 and everything.where("type IN ('warcinfo', 'other')").count() == 3
    reader = warc.WarcReader({"path": path}, everything.schema)
    left = list(reader.pushFilters([warc.EqualTo(("type",), "response"), warc.EqualTo(("payload_length",), 3)]))
    assert len(left) <= 1 and len(reader.partitions()) == 1
    small = warc.WarcReader({"path": path, "partition_bytes": "1"}, everything.schema)
    assert len(small.partitions()) == 3


def test_failed_attempts_are_not_read(spark, tmp_path):
    warc.use_warc(spark)
    path = f"{tmp_path}/out"
    pages = spark.createDataFrame([(1, "u", "hello")], "page_id bigint, url string, html string")
    warc.page_records(pages).write.format("warc").mode("append").save(path)
    (tmp_path / "out" / "part-00000-lost.warc.gz").write_bytes(b"half a record")
    assert spark.read.format("warc").load(path).count() == 1
    assert new_folder(spark, "x") != new_folder(spark, "x")
