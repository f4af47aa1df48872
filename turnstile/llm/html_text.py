"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams a page's events.  Block elements cut it into lines; a line has its text, the tags
that opened in it, the containers around it, and whether one of these is furniture by its name, role, class or id (menus,
headers, footers, side bars, notices, adverts, forms, scripts, reader comments).  A form, or a side bar or another part of
the layout by its class, that holds more than half of a page's text is no furniture: it wraps the page.

Furniture counts as text of ratio 0.  The ratios of text to tags per line are smoothed with a Gaussian kernel, and lines
above a threshold (a share of their standard deviation) are clustered: those of each article, and those outside of all.  The
cluster with most text wins.  Where it is an article, the region is that article and all others of at least a third of its
text.  Else it is the innermost container of four fifths of the cluster, without the articles in it, and the headings just
before it.  All lines of the region that are not furniture are the text, however short.

Null counts as empty.  A page without text gives an empty text.  A comment that is never closed is none, and what follows
the last ``>`` is text.  Work grows with the length of a page, whatever its markup; a page is held in memory as a whole and
its text once more.  Pages are independent, so repeated rows, ties and extra columns
change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RADIUS = 2
THRESHOLD = 0.5
#: Of the best article's text, what another one needs to be content too.
ALSO = 1 / 3
#: Of the best cluster's text, what its container must hold.
HELD = 0.8

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "tfoot thead title tr ul".split()
)
SPACED = {"br", "td", "th", "wbr", "img"}
FURNITURE = set(
    "aside button canvas dialog footer form head header iframe input menu nav noscript object option script select style "
    "svg template textarea title".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = set(
    "ad ads advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Hints that name a part of the layout: what holds most of a page's text is not furniture by them.
LAYOUT = set("banner header masthead modal overlay popup sidebar skip toolbar widget widgets".split())
#: Words that stand next to a hint in a name without changing what it says.
BESIDE = set(
    "area article bar block body bottom box button buttons col column container content count desktop entry fixed form "
    "global group inner item items large left link links list main mobile outer page panel post primary reader right "
    "row secondary section site slot small sticky text thread title top unit user wrap wrapper".split()
)
#: Elements that hold the whole page or its article: their class and id say nothing about furniture.
WHOLE = {"html", "body", "main", "article"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element that opens one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"option", "title", "head", "html", "body"}
_NAMES = re.compile(r"[^\s]+")
_TOKENS = re.compile(r"[a-z]+")


#: Containers of a line that are told apart; what is nested deeper counts as in the last of them.
DEEPEST = 64
#: Elements that hold lines.
CONTAINERS = {"article", "body", "center", "div", "fieldset", "form", "main", "section", "table", "tbody", "td", "tr"}


def furniture_of(tag: str, attrs: dict[str, str | None], in_article: bool) -> str:
    """``""``, or ``"layout"`` if the element is none after all where it wraps the page, or ``"always"``."""
    if tag in FURNITURE:
        return "" if tag == "header" and in_article else "layout" if tag == "form" else "always"
    if tag in WHOLE and not in_article:
        return ""
    if "hidden" in attrs or (attrs.get("role") or "").lower() in ROLES:
        return "always"
    found = ""
    for name in _NAMES.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()):
        tokens = set(_TOKENS.findall(name))
        hints = HINTS & tokens
        if hints and tokens <= HINTS | BESIDE and not (in_article and hints == {"header"}):
            if not hints <= LAYOUT:
                return "always"
            found = "layout"
    return found


class Line(NamedTuple):
    text: str
    tags: int
    #: Whether furniture at any rate, and the elements that make it furniture unless they wrap the page.
    always: bool
    layout: tuple[int, ...]
    #: The number of the article around it, -1 if there is none.
    article: int
    #: The elements around it that hold lines, outermost first.
    containers: tuple[int, ...]
    heading: bool


class Open(NamedTuple):
    """An open element, with what holds from there on."""

    tag: str
    always: bool
    layout: tuple[int, ...]
    article: int
    containers: tuple[int, ...]


NOTHING = Open("", False, (), -1, ())


class Lines(HTMLParser):
    """A page's lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[Open] = []
        #: Where in the stack elements of each name stand, and all blocks.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.parts: list[str] = []
        self.tags, self.articles, self.elements, self.heading = 0, 0, 0, False

    def read(self, html: str) -> list[Line]:
        """Markers that nothing closes are taken out first: the parser would look for an end after each of them."""
        html = html.replace("<![", "<!")
        closed = html.rfind("-->") + 1
        html = html[:closed] + html[closed:].replace("<!--", "")
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        self.parts.append(unescape(html[end:]))
        self._flush()
        return self.lines

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            top = self.stack[-1] if self.stack else NOTHING
            self.lines.append(Line(text, self.tags, *top[1:], self.heading))
        self.parts, self.tags, self.heading = [], 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
        elif tag in SPACED:
            self.parts.append(" ")
        if tag in ENDS_PARAGRAPH and self.places.get("p") and self.blocks[-1] == self.places["p"][-1]:
            self._cut(self.blocks[-1])
        self.tags += 1
        if tag in VOID:
            return
        _, always, layout, article, containers = self.stack[-1] if self.stack else NOTHING
        kind = furniture_of(tag, dict(attrs), article >= 0)
        self.elements += 1
        always = always or kind == "always"
        if kind == "layout":
            layout = (*layout, self.elements)
        if tag in ("article", "main") and article < 0 and not always:
            article, self.articles = self.articles, self.articles + 1
        if tag in CONTAINERS and len(containers) < DEEPEST:
            containers = (*containers, self.elements)
        self.heading = self.heading or tag in HEADINGS
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(Open(tag, always, layout[:DEEPEST], article, containers))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _cut(self, at: int) -> None:
        """Closes the element at this place and all within it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._flush()
        places = self.places.get(tag)
        # What is not open is not closed, and inline elements do not close blocks.
        if places and (tag in BLOCKS or not self.blocks or self.blocks[-1] < places[-1]):
            self._cut(places[-1])

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def smoothed(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; beyond the ends is nothing."""
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-(offsets**2) / (2 * radius**2)) if radius else np.ones(1)
    return np.convolve(values, kernel / kernel.sum(), mode="full")[radius : radius + len(values)]


def _usable(lines: list[Line]) -> list[bool]:
    """Which lines have text and are not furniture."""
    total, held = 0, Counter()
    for line in lines:
        if not line.always:
            total += len(line.text)
            for element in line.layout:
                held[element] += len(line.text)
    wraps = {element for element, n in held.items() if 2 * n > total}
    return [bool(x.text) and not x.always and wraps.issuperset(x.layout) for x in lines]


def _outside(lines: list[Line], usable: list[bool], best: list[int]) -> list[bool]:
    """The region around these lines, which stand in no article."""
    held: Counter[int] = Counter()
    for i in best:
        for container in lines[i].containers:
            held[container] += len(lines[i].text)
    most = HELD * sum(len(lines[i].text) for i in best)
    # Of nested containers, the inner one has the greater number.
    around = max((c for c, n in held.items() if n >= most), default=None)
    region = [x.article < 0 and (around is None or around in x.containers) for x in lines]
    first = region.index(True)
    while first and (not lines[first - 1].text or usable[first - 1] and lines[first - 1].heading and lines[first - 1].article < 0):
        first -= 1
        region[first] = True
    return region


def main_text(html: str | None) -> str:
    lines = Lines().read(html or "")
    usable = _usable(lines)
    if not any(usable):
        return ""
    ratio = np.array([len(line.text) / max(1, line.tags) if ok else 0.0 for line, ok in zip(lines, usable)])
    above = (smoothed(ratio) > THRESHOLD * ratio.std()) & np.array(usable)
    if not above.any():
        above = np.array(usable)
    clusters: dict[int, list[int]] = {}
    for i in np.nonzero(above)[0].tolist():
        clusters.setdefault(lines[i].article, []).append(i)
    size = {article: sum(len(lines[i].text) for i in own) for article, own in clusters.items()}
    best = max(size, key=lambda article: (size[article], article))
    if best < 0:
        region = _outside(lines, usable, clusters[best])
    else:
        chosen = {article for article, n in size.items() if article >= 0 and n >= ALSO * size[best]}
        region = [line.article in chosen for line in lines]
    return "\n\n".join(line.text for line, ok, inside in zip(lines, usable, region) if ok and inside)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("_llm_html")]
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of each row of ``pages``."""
    slim = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").alias("_llm_html"))
    return slim.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
