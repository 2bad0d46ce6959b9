"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_or_empty

#: Elements of HTML by what they mean here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is no text of the page: scripts, styles, other markup, and the controls of forms. Formulas, drawings' and hidden text are text.
HIDDEN = frozenset("script style noscript template head title iframe noframes noembed textarea select datalist button".split())
SIDE = frozenset("nav header footer aside form menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("article main section div td body".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
SIDE_NAMES = frozenset("ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead comment comments disqus replies respond cookie cookies consent gdpr notice popup modal newsletter subscribe signup share sharing social related recommended toolbar pagination pager widget copyright login".split())
#: Of these, names that stand for what others wrote or for other pages, which come as articles too.
FIRM_NAMES = frozenset("ad ads advert adverts advertisement sponsored promo comment comments disqus replies respond related recommended".split())
#: A class such as has-sidebar or page-with-nav tells of the page, not of the element that bears it.
STATES = frozenset("has have with without no not is are show hide page layout".split())
#: A <p> is closed by these, as browsers do, and an item by its like.
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA = 1.0


def side_names(attrs: dict) -> set[str]:
    """The words of an element's classes and id by which it is a side of the page."""
    found: set[str] = set()
    for key in ("class", "id"):
        for name in (attrs.get(key) or "").split():
            words = [w.lower() for w in NAMES.findall(name)]
            if words and words[0] not in STATES:
                found.update(words)
    return found & SIDE_NAMES


class Line:
    __slots__ = ("text", "tags", "links", "path", "heading", "side", "soft")

    def __init__(self, text: str, tags: int, links: int, path: tuple, heading: bool, side: bool, soft: tuple = ()):
        self.text, self.tags, self.links, self.path, self.heading, self.side, self.soft = text, tags, links, path, heading, side, soft

    @property
    def ratio(self) -> float:
        return (len(self.text) - self.links) / max(1, self.tags)


class Events(HTMLParser):
    """Turns parser events into lines, one for each block of text; open elements are a stack."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool, bool, tuple]] = []  # tag, number, hidden, side, soft: forms and named elements around
        self.holders: set[int] = set()  # soft ones that hold an article or main
        self.firm: set[int] = set()  # soft ones of a firm name
        self.count = self.tags = self.links = self.anchors = 0
        self.words: list[str] = []

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.words)).strip()
        if text:
            path = tuple((t, n) for t, n, *_ in self.stack if t in CONTAINERS)
            heading = any(t in HEADINGS for t, *_ in self.stack)
            side, soft = self.stack[-1][3:] if self.stack else (False, ())
            self.lines.append(Line(text, self.tags, self.links, path, heading, side, soft))
            self.tags = 0
        self.words, self.links = [], 0

    def _pop(self, to: int) -> None:
        for tag, *_ in self.stack[to:]:
            self.anchors -= tag == "a"
        del self.stack[to:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P:
                self._close({"p"}, {"table", "td", "th", "button"})
            if tag in SIBLINGS:
                self._close(SIBLINGS[tag], {"ul", "ol", "dl", "table"} if tag != "td" and tag != "th" else {"tr", "table"})
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        _, _, hidden, side, soft = self.stack[-1] if self.stack else ("", 0, False, False, ())
        got = dict(attrs)
        hidden = hidden or tag in HIDDEN
        if tag == "main" or tag == "article" and not any(t in ("aside", "footer", "dialog", "menu", "search") for t, *_ in self.stack):
            # what is around it is no side of the page, unless an article may be a comment or a teaser
            kept = () if tag == "main" else tuple(n for n in soft if n in self.firm)
            self.holders.update(n for n in soft if n not in kept)
            side, soft = False, kept
        if not side and tag not in ("html", "body", "article", "main"):
            # an article's own header holds its headline
            inside = any(t in ("article", "main") for t, *_ in self.stack)
            own = tag == "header" and inside
            named = side_names(got) - ({"header"} if inside else set())
            side = tag in SIDE and tag != "form" and not own or (got.get("role") or "").lower() in SIDE_ROLES - {"form"}
            if not side and (tag == "form" or (got.get("role") or "").lower() == "form" or bool(named) and not own):
                soft = (*soft, self.count + 1)
                if named & FIRM_NAMES:
                    self.firm.add(self.count + 1)
        self.count += 1
        self.anchors += tag == "a"
        self.stack.append((tag, self.count, hidden, side, soft))

    def _close(self, tags: set, stop: set) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return self._pop(k)
            if self.stack[k][0] in stop or self.stack[k][0] in CONTAINERS and self.stack[k][0] != "section":
                return None

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        self.words.append(data)
        if self.anchors:
            self.links += len(data.strip())


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over the lines; the kernel is renormalised at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    weight = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = weight[abs(i - j)]
            total += w * values[j]
            norm += w
        out.append(total / norm)
    return out


def threshold(values: list[float]) -> float:
    """One standard deviation of the smoothed ratios, the cut between the two clusters of lines; the mean where that is less, so that some line is content."""
    mean = sum(values) / len(values)
    return min(mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)))


def main_text(html: str) -> str:
    """The page's main text: blocks in page order, joined by a line feed.

    Lines in side elements take no part. A form, or an element that only its class or id names a side, is none if it
    holds an article or main (one of a comment's, ad's or teaser's name: a main) or, on a page without them, half of the
    characters outside of sides (nine tenths). Lines whose smoothed ratio reaches
    the threshold are content; the region is the article or main elements that hold content, if together they hold half
    of its characters (the smallest around the most of them, and its siblings), else the smallest container that holds
    nine tenths of them. All of the region's lines are returned, the short ones too, as they belong to it. A page without
    text gives an empty string.
    """
    events = Events()
    events.feed(html)
    events.close()
    events.flush()
    lines = [x for x in events.lines if not x.side]
    size: dict[int, int] = {}
    for x in lines:
        for n in x.soft:
            size[n] = size.get(n, 0) + len(x.text)
    total = sum(len(x.text) for x in lines)
    marked = any(t in ("article", "main") for x in lines if events.holders.issuperset(x.soft) for t, _ in x.path)
    open_ = events.holders | {n for n in size if not marked and size[n] * 10 > total * (9 if n in events.firm else 5)}
    lines = [x for x in lines if open_.issuperset(x.soft)]
    if not lines:
        return ""
    even = smooth([x.ratio for x in lines])
    cut = threshold(even)
    content = [x for x, v in zip(lines, even) if v >= cut]
    chars: dict[tuple, int] = {}
    depth: dict[tuple, int] = {}
    for x in content:
        for d, node in enumerate(x.path):
            chars[node] = chars.get(node, 0) + len(x.text)
            depth[node] = d
    total = sum(len(x.text) for x in content)
    named = [n for n in chars if n[0] in ("article", "main")]
    best = max(named, key=lambda n: (chars[n], depth[n]), default=None)
    # siblings: all articles that hold content lines and neither hold the best one nor are inside it
    around = {n for x in content if best in x.path for n in x.path}
    siblings = {best, *(n for n in named if n not in around)}
    if best is not None and 2 * sum(len(x.text) for x in content if not siblings.isdisjoint(x.path)) >= total:
        region = [x for x in lines if not siblings.isdisjoint(x.path)]
    else:
        full = [n for n in chars if chars[n] * 10 >= 9 * total]
        inner = max(full, key=lambda n: depth[n], default=None)
        region = [x for x in lines if inner is None or inner in x.path]
    return "\n".join(x.text for x in region)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with, last, a struct `_main` (with underscores added where pages has that name): text and its code points chars.

    A null page counts as empty. Markup that does not end, unknown elements and bare text are read as far as
    they go; nothing is cut to a length. Equal pages give equal texts. An empty table gives an empty result; columns of
    pages stay as they are.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x or "") for x in batch], dtype="object")

    name = free_name(pages, "_main")
    out = pages.withColumn(name, run.asNondeterministic()(text_or_empty(F.col(html_col))))
    return out.withColumn(name, F.struct(F.col(name).alias("text"), F.length(name).cast("long").alias("chars")))
