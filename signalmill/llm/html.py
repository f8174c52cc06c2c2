"""HTML extraction: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's streaming parser turns a page into lines, one per block, each with
its text, its tags, its links and its innermost container. Ratios of text to tags, less the
share of links and zero in marked boilerplate, are smoothed with a Gaussian, and lines above
a threshold are content.
The smallest container of all of them is the content region; lines in it that fall short of
the threshold count where they stand among content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import table

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Opened and closed on the stack; other tags only count.
HOLDERS = frozenset("article aside blockquote body button dialog div dl fieldset figure footer form head header iframe main menu nav noscript ol script section select span style svg table template textarea title ul".split())
#: Tags whose text is no part of a page's prose.
NEVER = frozenset("button head iframe noscript script select style svg template textarea title".split())
#: Tags that mark boilerplate; what a form holds may turn out to be the page.
MARKS = frozenset("aside dialog footer menu nav".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words of class, id and role attributes that mark boilerplate; the second set only outside an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "comment comments disqus reply replies respond share sharing social related recommended recommendations promo promotion popup modal newsletter subscribe signup login search "
    "pagination pager toolbar widget footer copyright hidden complementary contentinfo".split()
)
OUTSIDE = frozenset("header masthead top topbar site-header logo skip".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
SIGMA, RADIUS = 1.0, 2
#: A mark by name is taken back where less than this share of the page's text stands outside marks; nested marks at most so often.
OUTSIDE_SHARE, LIFTS = 0.05, 8


class Lines(HTMLParser):
    """Collects the lines of a page: text, tags, characters of links, container, and whether a marked block without a container holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        # Containers by number: tag, number of the parent, mark ("" none, "tag" or "name").
        self.kinds, self.parents, self.marks = [""], [-1], [""]
        self.stack: list[int] = [0]
        self.open: Counter = Counter()
        self.never = 0
        self.loose = ""  # a marked <p> or <li>, which the next block ends
        self.text: list[str] = []
        self.tags = self.links = self.anchors = 0

    def end_line(self):
        text = " ".join("".join(self.text).split()) if self.text else ""
        if text:
            self.lines.append((text, self.tags, self.links, self.stack[-1], bool(self.loose)))
            self.tags = 0
        self.text, self.links = [], 0

    def _mark(self, tag: str, attrs: list) -> str:
        inside = self.open["article"] + self.open["main"] > 0
        if tag in MARKS:
            return "tag"
        if tag == "form" or tag == "header" and not inside:
            return "name"
        if not attrs or tag in ("body", "main", "html"):
            return ""
        said = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in said or "display:none" in said.get("style", "").replace(" ", ""):
            return "tag"
        words = {w for k in ("class", "id", "role") if k in said for w in _SPLIT.split(said[k])}
        if tag == "article":
            return "name" if words & {"comment", "comments", "reply", "ad", "advert", "related"} else ""
        return "name" if words & NAMES or not inside and words & OUTSIDE else ""

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if self.loose and tag != "br":
                self.loose = ""
        self.anchors += tag == "a"
        if tag in VOID:
            return
        mark = self._mark(tag, attrs)
        if tag in HOLDERS:
            self.kinds.append(tag)
            self.parents.append(self.stack[-1])
            self.marks.append(mark)
            self.stack.append(len(self.kinds) - 1)
            self.open[tag] += 1
            self.never += tag in NEVER
        elif mark and tag in BLOCKS:
            self.loose = tag

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag == "a":
            self.anchors = max(self.anchors - 1, 0)
        if tag == self.loose:
            self.loose = ""
        if self.open[tag] > 0:
            while True:
                name = self.kinds[self.stack.pop()]
                self.open[name] -= 1
                self.never -= name in NEVER
                if name == tag:
                    break

    def handle_data(self, data):
        if not self.never:
            self.text.append(data)
            self.links += len(data) if self.anchors else 0


def lines_of(html: str) -> Lines:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser


def clustered(ratio: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which lines are content: the smoothed ratios that reach their deviation. Lines of weight 0 never are."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-x * x / (2 * SIGMA**2))
    smooth = np.convolve(ratio * weight, kernel / kernel.sum(), "full")[RADIUS : RADIUS + len(ratio)] * weight
    return (smooth > 0) & (smooth >= smooth.std())


def _under(parents: list[int], marked: list[bool]) -> np.ndarray:
    """The outermost marked container over each container, itself included; -1 for none."""
    top = []
    for i, p in enumerate(parents):
        above = top[p] if p >= 0 else -1
        top.append(above if above >= 0 or not marked[i] else i)
    return np.array(top)


def weights(page: Lines, length: np.ndarray, at: np.ndarray, loose: np.ndarray) -> np.ndarray:
    """1 for lines outside boilerplate marks, 0 for those in them.

    Where hardly any text stands outside, the name that marks the container of most text
    names the page, not its boilerplate, and is taken back.
    """
    marked = [bool(m) for m in page.marks]
    for _ in range(LIFTS):
        top = _under(page.parents, marked)
        held = np.bincount(top[at] + 1, length * ~loose, len(marked) + 1)
        best = int(held[1:].argmax())
        if held[0] >= OUTSIDE_SHARE * held.sum() or not held[1 + best] or page.marks[best] != "name":
            break
        marked[best] = False
    return ((_under(page.parents, marked)[at] < 0) & ~loose).astype(float)


def extract(html: str | None) -> str:
    """Main text of a page. Null, empty or text-free pages, and pages of boilerplate alone, give the empty string."""
    page = lines_of(html or "")
    if not page.lines:
        return ""
    text, tags, links, at, loose = zip(*page.lines)
    at, loose = np.array(at), np.array(loose)
    length = np.array([len(t) for t in text], float)
    weight = weights(page, length, at, loose)
    prose = 1 - np.minimum(np.array(links) / length, 1)
    content = clustered(length / np.maximum(tags, 1), weight * prose)
    if not content.any():
        return ""
    # The smallest container of all content lines: numbers ascend from parent to child.
    held = np.bincount(at[content], minlength=len(page.kinds)).tolist()
    direct = np.array(held) > 0
    for i in range(len(held) - 1, 0, -1):
        if held[i]:
            held[page.parents[i]] += held[i]
    region = max(i for i, n in enumerate(held) if n == held[0])
    inside = _under(page.parents, [i == region for i in range(len(held))]) >= 0
    # Short lines of the region: all but lists of links in a container of its own, else those beside or between content lines.
    where = np.flatnonzero(content)
    own = page.kinds[region] not in ("", "html", "body")
    among = (np.arange(len(text)) > where[0]) & (np.arange(len(text)) < where[-1])
    keep = content | inside[at] & (weight > 0) & (direct[at] | (prose > 0.5) & (own | among))
    return " ".join(t for t, k in zip(text, keep) if k)


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text, n_chars for every row; repeated rows and null ids are kept, an empty table gives none."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h) for h in batch.pop("h")]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    kind = pages.schema[id_col].dataType.simpleString()
    ready = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("h"))
    return ready.mapInPandas(each, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
