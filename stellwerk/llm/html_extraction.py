"""Main text of web pages as the maximum-scoring run of page tokens.

A page is a sequence of words and tags. A word scores +1, or 0 inside an element that never belongs to an
article (menus, forms, adverts, comments and the like, by element name or by a word of its class or id);
a tag scores below zero, by how rarely tags of its name stand inside the articles of labelled pages. One
linear scan finds the contiguous run with the highest sum, and its text is the result, without the elements
named above.

Labelled pages are those with an ``article`` or ``main`` element around their text; ``learn`` counts tags in
about ``sample`` (2,000) of them, drawn by a hash of page_id. Names that sample doesn't show get a fixed score.

A class or id names an element's kind where one of its parts (``site-footer``) is a known word, unless another part says that
it describes a state of what is inside (``has-sidebar``, ``comments-open``). The first article or main element of a page ends
such a mark of the elements around it. Elements whose end tag may be left out end where HTML lets them.

Text is split into blocks at block elements; character references are decoded, white space inside a block
becomes one blank, and blocks are joined by an empty line. Scripts, styles, comments, declarations and a tag
cut off at the end of the page are no text. Null html counts as empty; a page without words outside unwanted
elements has an empty text. Repeated pages have equal results.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th wbr option".split())
UNWANTED = frozenset(
    "aside button canvas dialog footer form head iframe input label map menu nav noscript object option select svg template textarea title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
# Words of class and id attributes that mark what is not the article.
UNWANTED_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead "
    "menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related respond share sharing sidebar "
    "skip social sponsor sponsored subscribe subscription toolbar widget".split()
)

# Parts of class names that tell a state or a lack, not what the element is.
STATE_WORDS = frozenset(
    "active closed disabled enabled free has hide intro is layout no not off on open ready show support supports with without".split()
)
# Elements that may lack their end tag, the start tags that end them, and the elements whose end does.
ENDED_BY = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]),
    "tbody": frozenset(["tbody", "tfoot"]),
    "head": BLOCKS,
}
_TABLE = frozenset(["table"])
PARENTS = {
    "p": BLOCKS - {"p"},
    "li": frozenset(["ul", "ol", "menu"]),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "option": frozenset(["select", "datalist"]),
    "tr": _TABLE,
    "td": _TABLE,
    "th": _TABLE,
    "thead": _TABLE,
    "tbody": _TABLE,
    "head": frozenset(["html"]),
}

UNSEEN = -3.0
LOWEST = -12.0
HIGHEST = -0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>"
    r"|</?[a-zA-Z][^<>]*\Z"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile("[a-z]+")


def _marked(attributes: str) -> bool:
    """Whether class, id or role name something other than the article."""
    for found in _MARKS.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            parts = _PART.findall(name)
            if not UNWANTED_WORDS.isdisjoint(parts) and STATE_WORDS.isdisjoint(parts):
                return True
    return False


class _Skip:
    """An unwanted element, from its start tag on."""

    def __init__(self, name: str, marked: bool):
        self.name, self.marked = name, marked
        self._same, self._parents = 1, 0

    def ends_before(self, name: str, closing: bool) -> bool:
        """Whether a tag implies the element's end and lies outside it."""
        if closing:
            if name in PARENTS.get(self.name, ()):
                self._parents -= 1
            return self._parents < 0
        if name in ENDED_BY.get(self.name, ()) and not self._parents:
            return True
        if name in PARENTS.get(self.name, ()):
            self._parents += 1
        return False

    def ends_at(self, name: str, closing: bool) -> bool:
        """Whether a tag is the element's own end tag. Elements of its name inside it are counted."""
        if name == self.name:
            self._same += -1 if closing else 1
        return not self._same or (closing and name in MAIN)


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """Tags as ("<" or "/", name, unwanted) and pieces of text as ("", text, unwanted), in page order.

    ``unwanted`` tells whether the place lies in an unwanted element.
    """
    at, inside, seen = 0, 0, False
    skip: _Skip | None = None
    for found in _TOKEN.finditer(page):
        if found.start() > at:
            yield "", page[at : found.start()], skip is not None
        at = found.end()
        if found[3] is None:
            continue
        name, closing = found[3].lower(), found[2] == "/"
        if skip and (skip.ends_before(name, closing) or (name in MAIN and not closing and not seen and skip.marked and not _marked(found[4]))):
            skip = None
        if name in MAIN:
            inside += -1 if closing else 1
            seen = seen or skip is None
        if skip:
            if skip.ends_at(name, closing):
                skip = None
                yield "/", name, True
                continue
        elif not closing and name not in VOID and name not in ("html", "body"):
            kind = name in UNWANTED or (name == "header" and inside < 1)
            if kind or (name not in MAIN and found[4] and _marked(found[4])):
                skip = _Skip(name, not kind)
        yield "/" if closing else "<", name, skip is not None
    if at < len(page):
        yield "", page[at:], skip is not None


def main_text(page: str, scores: dict[str, float]) -> str:
    parts = list(tokens(page))
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, value, unwanted) in enumerate(parts):
        if kind:
            total += scores.get(value, UNSEEN)
        elif not unwanted:
            total += len(value.split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_range = total, (start, i + 1)
    blocks, block = [], []
    for kind, value, unwanted in parts[best_range[0] : best_range[1]]:
        if not kind:
            if not unwanted:
                block.append(value)
        elif value in BLOCKS or unwanted:
            blocks.append("".join(block))
            block = []
        elif value in SPACED:
            block.append(" ")
    blocks.append("".join(block))
    return "\n\n".join(t for b in blocks if b and (t := " ".join(html.unescape(b).split())))


def _tag_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for page in batch.column("html").to_pylist():
            depth = 0
            for kind, name, _ in tokens(page):
                if not kind:
                    continue
                depth += (kind == "<") - (kind == "/") if name in MAIN else 0
                counts.setdefault(name, [0, 0])[0 if depth > 0 and name not in MAIN else 1] += 1
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in rows], pa.string()), pa.array([c[0] for _, c in rows], pa.int64()), pa.array([c[1] for _, c in rows], pa.int64())],
        names=["name", "inside", "outside"],
    )


def learn(pages: DataFrame, sample: int = 2000) -> dict[str, float]:
    """Scores of the tags of the sample: twice the logarithm of the share that stands inside articles."""
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)\\b"))
    n = labelled.count()
    part = labelled.where(F.shiftrightunsigned(F.xxhash64("page_id"), 11) < min(1.0, sample / max(n, 1)) * float(1 << 53)).select(F.col("html").cast("string").alias("html"))
    counts = part.mapInArrow(_tag_counts, "name string, inside bigint, outside bigint").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return {r.name: min(HIGHEST, max(LOWEST, 2 * math.log((r.inside + 1) / (r.inside + r.outside + 2)))) for r in counts.collect()}


def _texts(scores: dict[str, float]):
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page or "", scores) for page in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    return extract


def extract_text(pages: DataFrame, scores: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``page_id, url, html``; learns the scores from the pages if none are given."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    scores = learn(rows) if scores is None else scores
    found = rows.mapInArrow(_texts(scores), "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
