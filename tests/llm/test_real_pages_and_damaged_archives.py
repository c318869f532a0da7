"""Pages as they are found in the wild keep their whole article; damaged archives are errors."""

import gzip

import pytest

from stellwerk.llm import html_extraction, warc

SCORES = {"p": -0.2, "article": -1.0, "div": -2.0, "form": -4.0, "input": -3.0, "li": -1.5, "section": -1.0, "body": -3.0, "html": -3.0, "head": -6.0, "nav": -6.0}
FIRST = "The first paragraph of the article has a good number of plain words in it."
SECOND = "The second paragraph follows with about as many words as the first one had."
WHOLE = f"{FIRST}\n\n{SECOND}"
BODY = f"<p>{FIRST}</p><p>{SECOND}</p>"

PAGES = {
    "state of a wrapper": f'<div class="layout has-sidebar"><article>{BODY}</article></div>',
    "open comments": f'<body class="post comments-open"><div class="comments-open"><article>{BODY}</article></div>',
    "article inside a marked wrapper": f'<div class="widget"><article>{BODY}</article></div>',
    "paragraph without end": f'<article><p class="share">Share this<p>{FIRST}<p>{SECOND}</article>',
    "list entry without end": f'<article><ul><li class="share">Share<ul><li>deeper</ul></ul>{BODY}</article>',
    "head without end": f"<html><head><title>Name</title><body><article>{BODY}</article></html>",
    "form in mid-article": f'<article><p>{FIRST}</p><form>{"many words of a form " * 30}</form><p>{SECOND}</p></article>',
    "intro to skip": f'<article><p class="skip-intro">{FIRST}</p><section class="widget-free"><p>{SECOND}</p></section></article>',
    "quote in a bare value": f"<article><p data-x=it's>{FIRST}</p><p title='a>b' data-y=\"c'>d\">{SECOND}</p></article>",
    "marked parts": f'<div class="site-footer">About us and more</div><article>{BODY}</article><div id="comments"><article class="comment"><p>{"I disagree with all of it. " * 9}</p></article></div>',
    "related articles": f'<article>{BODY}</article><div class="related"><article><p>{"Another story you may like. " * 9}</p></article></div>',
}


@pytest.mark.parametrize("name", PAGES)
def test_whole_article(name):
    assert html_extraction.main_text(PAGES[name], SCORES) == WHOLE


def test_cut_off_tag_with_many_attributes_ends():
    page = "<p>text of it</p><a " + 'x="y" ' * 5000
    assert html_extraction.main_text(page, SCORES) == "text of it"


def archive(n=4):
    return [warc.record_bytes({"record_id": f"<urn:{i}>", "type": "response", "target_uri": f"http://x/{i}", "payload": b"body %d" % i}) for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_damaged_archives(spark, tmp_path, packed):
    warc.use_warc(spark)
    records = archive()
    whole = [gzip.compress(r) for r in records] if packed else records
    cases = {
        "cut": [*whole[:3], whole[3][: len(whole[3]) - 12]],
        "garbage": [*whole[:2], gzip.compress(b"no record") if packed else b"no record at all\r\n\r\nx\r\n", *whole[2:]],
    }
    for name, parts in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"a.warc{'.gz' if packed else ''}").write_bytes(b"".join(parts))
        with pytest.raises(Exception, match="no record of an archive|bytes|decompress"):
            spark.read.format("warc").load(str(tmp_path / name)).collect()
