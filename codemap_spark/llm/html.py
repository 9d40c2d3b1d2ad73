"""Main-text extraction from HTML by text-to-tag ratios.

The standard library's streaming parser turns a page into events.  Block tags
start a new line; a line has text characters and tags.  Its text-to-tag ratio
is smoothed with a Gaussian over the page, and lines above a threshold (a share
of the ratios' standard deviation) form the content clusters.  The innermost
container that holds nearly all of the clusters' text is the content region;
inside it the clustered lines stay, and short lines of the same container.

Tags that say what they are (menus, footers, scripts, ...) and hidden elements
are left out where they are closed; one that is never closed leaves nothing
out, and ratios decide.  A form is left out unless it holds most of the
clusters' text, as one around a whole page does.  Class and id names, and links
outside of articles, lower the level of their lines, which the threshold then
passes or not.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold running text, closed or not.
NEVER = frozenset("script style noscript template svg math iframe object select option textarea canvas audio video title".split())
#: Elements that name another part of the page than its article.
DROPPED = frozenset("nav header footer aside button dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
#: Elements that may be the content region.
CONTAINERS = frozenset("html body article main section div center table tbody tr td".split())
#: A name is taken as a hint if its words are all in these two lists and one is in the first.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommendations recommended related replies respond search share sharing sidebar signup social "
    "sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
PARTS = frozenset(
    "area articles bar block bottom box button buttons container content field form global group head icons inner item items left link links list main message outer page panel post posts primary reader "
    "right row secondary section site slot stories text thread top unit user view visitor wrap wrapper".split()
)
#: Names written as one word, such as commentlist.
JOINED = frozenset(x for h in HINTS if len(h) > 2 for p in PARTS for x in (h + p, p + h)) - PARTS
#: Inside an article these may name its own matter; lines are lowered to MILD there.
AMBIGUOUS = frozenset("banner footer header login menu menus navigation notice notices pager pagination replies respond search social toolbar widget widgets".split())
#: Elements of running text, whose names say nothing about the page's parts.
UNNAMED = frozenset("html body blockquote figure figcaption h1 h2 h3 h4 h5 h6 p pre dd dt dl".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden)")
CLOSED_BLOCKS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: What a hint, a hint that may mean an article's own matter, and a link leave of a line's level.
LOWERED, MILD, LINKED = 0.002, 0.5, 0.05
#: Share of the clustered text that the content region holds, and that a
#: container holds among its own lines for its other lines to stay.
REGION_SHARE, LINE_SHARE = 0.85, 0.5


@lru_cache(maxsize=65_536)
def hinted(names: str, in_article: bool) -> float:
    """What a class or id attribute leaves of the level of its lines: less than
    1 if it names another part than the article."""
    left = 1.0
    for name in names.split():
        words = {w.lower() for w in WORD.findall(name)}
        if in_article:
            words -= {"header"}
        hints = words & HINTS | words & JOINED
        if hints and words <= HINTS | PARTS | JOINED:
            left = min(left, MILD if in_article and hints <= AMBIGUOUS else LOWERED)
    return left


class Lines(HTMLParser):
    """Collects lines and the tree of elements from the event stream."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # of every line: text, tags, characters in links, element, is a heading
        self.text: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.element: list[int] = []
        self.heading: list[bool] = []
        # of every block element: parent, tag, left out if closed, what its names leave of levels, closed, in an article
        self.parent, self.tag, self.left_out, self.named, self.closed, self.in_article = [0], ["html"], [False], [1.0], [False], [False]
        self.open: list[tuple[str, int, bool]] = []  # tag, element, in an article or main
        self.parts: list[str] = []
        self.count = self.links = self.in_link = self.never = 0

    def _top(self) -> tuple[int, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (0, False)

    def _end_line(self) -> None:
        if self.parts:
            words = " ".join("".join(self.parts).split())
            if words:
                element = self._top()[0]
                self.text.append(words)
                self.tags.append(self.count)
                self.linked.append(self.links)
                self.element.append(element)
                self.heading.append(self.tag[element] == "h1")
                self.count = 0
            self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in VOID:
            self.count += 1
            if tag not in INLINE:
                self._end_line()
            return
        if tag not in IN_HEAD and self.open and self.open[-1][0] == "head":
            self._pop(len(self.open) - 1, False)
        if tag in INLINE:
            self.count += 1
            self.in_link += tag == "a"
            self.open.append((tag, *self._top()))
            return
        if tag in CLOSED_BLOCKS_P or tag == "li":
            self._close_implied("li" if tag == "li" else "p")
        self._end_line()
        self.count += 1
        element, in_article = self._top()
        in_article = in_article or tag in ("article", "main")
        left_out = tag in NEVER or tag in DROPPED and not (tag == "header" and in_article) or tag == "head"
        named = 1.0
        if tag not in ("html", "body"):
            for name, value in attrs:
                if name == "hidden" or value and (name == "role" and value.strip().lower() in DROPPED_ROLES or name == "style" and HIDDEN.search(value)):
                    left_out = True
                elif value and name in ("class", "id") and tag not in UNNAMED:
                    named = min(named, hinted(value, in_article))
        self.never += tag in NEVER
        self.parent.append(element)
        self.tag.append(tag)
        self.left_out.append(left_out)
        self.named.append(named)
        self.closed.append(tag in NEVER)
        self.in_article.append(in_article)
        self.open.append((tag, len(self.parent) - 1, in_article))

    def _close_implied(self, tag: str) -> None:
        """A new block ends an open paragraph or item of the same parent."""
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                self._pop(at, False)
                return
            if name not in INLINE:
                return

    def _pop(self, at: int, closed: bool) -> None:
        self._end_line()
        self.closed[self.open[at][1]] |= closed
        for tag, _, _ in self.open[at:]:
            self.never -= tag in NEVER
            self.in_link -= tag == "a"
        del self.open[at:]

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag in VOID:
            return
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                self.count += 1
                if tag in INLINE:
                    # an inline end tag leaves the blocks inside alone
                    if all(x[0] in INLINE for x in self.open[at:]):
                        self.in_link -= sum(x[0] == "a" for x in self.open[at:])
                        del self.open[at:]
                else:
                    self._pop(at, True)
                return
            if tag in INLINE and name not in INLINE:
                return

    def handle_data(self, data) -> None:
        if not self.never:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data)

    def finish(self) -> None:
        self.close()
        self._end_line()


def smooth(ratio: np.ndarray, radius: int, sigma: float) -> np.ndarray:
    """Gaussian smoothing that renormalises at the ends of the page."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones_like(ratio), kernel)[radius : radius + len(ratio)]
    return np.convolve(ratio, kernel)[radius : radius + len(ratio)] / weight


def extract(html: str | None, radius: int = 2, sigma: float = 1.0, share: float = 0.5) -> str:
    """Main text of one page; empty for null, empty or text-free pages."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    elements = len(page.parent)
    # what is left out or named goes down the tree; elements come after their parents
    out, named = [False] * elements, [1.0] * elements
    for e in range(elements):
        up = page.parent[e]
        out[e] = out[up] or page.left_out[e] and page.closed[e]
        named[e] = min(named[up], page.named[e])
    container = list(range(elements))
    for e in range(1, elements):
        if page.tag[e] not in CONTAINERS:
            container[e] = container[page.parent[e]]
    forms = [e for e in range(elements) if page.tag[e] == "form" and page.closed[e] and not out[e]]
    while True:
        lines = [i for i, e in enumerate(page.element) if not out[e]]
        if not lines:
            return ""
        element = [page.element[i] for i in lines]
        length = np.array([len(page.text[i]) for i in lines], float)
        ratio = length / np.maximum(1, np.array([page.tags[i] for i in lines], float))
        linked = np.minimum(1, np.array([page.linked[i] for i in lines]) / length)
        linked[[page.in_article[e] for e in element]] = 0
        weight = (1 - (1 - LINKED) * linked) * np.array([named[e] for e in element])
        smoothed = smooth(ratio, radius, sigma)
        level = smoothed * weight
        content = level >= min(share * ratio.std(), level.max())
        # text of the clusters, by element and all that it holds
        mass = [0.0] * elements
        for e, n, on in zip(element, length.tolist(), content.tolist(), strict=True):
            mass[e] += n * on
        for e in range(elements - 1, 0, -1):
            mass[page.parent[e]] += mass[e]
        aside = [e for e in forms if mass[e] < LINE_SHARE * mass[0]]
        if not aside:
            break
        forms = [e for e in forms if e not in aside]
        for e in aside:
            out[e] = True
        for e in range(1, elements):
            out[e] = out[e] or out[page.parent[e]]

    own_mass, own_text = [0.0] * elements, [0.0] * elements
    for e, n, on in zip(element, length.tolist(), content.tolist(), strict=True):
        own_mass[container[e]] += n * on
        own_text[container[e]] += n
    inner: dict[int, int] = {}  # the container of most text inside each
    for e in range(1, elements):
        up = container[page.parent[e]]
        if page.tag[e] in CONTAINERS and (up not in inner or mass[e] > mass[inner[up]]):
            inner[up] = e
    region = 0
    while page.tag[region] != "article" and region in inner and mass[inner[region]] >= REGION_SHARE * mass[0]:
        region = inner[region]
    inside = [False] * elements
    for e in range(elements):
        inside[e] = e == region or inside[page.parent[e]]
    kept = [
        inside[e] and (on or w > 0.5 and own_mass[container[e]] >= LINE_SHARE * own_text[container[e]] or page.heading[i] and named[e] == 1)
        for i, e, on, w in zip(lines, element, content.tolist(), weight.tolist(), strict=True)
    ]
    # a headline may stand just before the region
    if any(kept) and not any(k and page.heading[i] for k, i in zip(kept, lines, strict=True)):
        before = [k for k in range(kept.index(True)) if page.heading[lines[k]] and named[element[k]] == 1]
        if before:
            kept[before[-1]] = True
    return " ".join(page.text[i] for i, k in zip(lines, kept, strict=True) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: id, the kept columns, text and n_chars.

    Null or empty html gives an empty text of 0 characters; repeated rows give
    repeated results; an empty table gives an empty one; other columns are not
    read, so their names can't clash.  No shuffle: a scan with one map.
    """
    prepare(pages.sparkSession)
    kept = [pages.schema[c] for c in (id_col, *keep)]
    source = pages.select(*[F.col(f.name) for f in kept], F.col(html_col).cast("string").alias("__html"))
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            text = [extract(x) for x in batch.column("__html").to_pylist()]
            columns = [batch.column(c) for c in names] + [pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(run, f"{fields}, text string, n_chars bigint")
