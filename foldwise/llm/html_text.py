"""Operator 10: main text of web pages.

The standard library's streaming parser turns a page into lines, one for each
block of text, with the number of characters and of tags that it took.  The
ratio of text to tags by line is smoothed with a Gaussian and compared with its
own spread; lines above form clusters of content, on every page.  Clusters are
widened to their containers: the deepest one that holds more than ``SHARE`` of the
clusters' text, or the ``article`` or ``main`` around it, is content, and all its
lines are kept, short ones too; then the same for the clusters beside it.  The
ratio counts ``PRIOR`` times within ``article`` and ``main``.  Menus, headers, footers, sidebars, notices, adverts,
forms, comments and the like are left out by element, role, class or id beforehand.
Outside articles a name that only holds such a word (``share-prices``) is doubtful: its
text is left out unless it makes up most of the clusters' text.

Defined results: null and empty pages give an empty text; markup that is broken
off or badly nested ends where its parents end; text that no element marks is a
block of its own; repeated rows are extracted each; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import columns_of, rows_out, small_batches

#: Elements without content of their own (fixed by the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul""".split())
#: Elements that never hold main text.
DROPPED = frozenset("""applet aside audio canvas datalist dialog embed fieldset footer form head iframe input label menu
meter nav noembed noframes noscript object optgroup option progress script select style svg template textarea title video""".split())
#: Elements that hold none outside an article.
OUTSIDE = frozenset("button header legend map".split())
#: Elements whose lines belong together.
REGIONS = frozenset("article main section div td body".split())
#: Words of class, id or role that mark what is not main text: in an article those
#: that make up a whole class or role, elsewhere all classes, the role or the id.
#: Headings and paragraphs go by whole classes and roles everywhere.
NOISE = frozenset("""ad ads adsense advert advertisement advertisements adverts alert announcement banner breadcrumb breadcrumbs captcha comment
commentlist comments complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr header hidden login masthead menu modal nav navbar
navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion related replies respond rss
search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget""".split())
#: Elements whose id is the slug of their text.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Radius of the Gaussian, in lines; the weight of a line's ratio in article and
#: main; and the share of the clusters' text that a container must hold.
RADIUS, PRIOR, SHARE = 1, 2.0, 0.8


def noisy(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no main text, and whether its names make that doubtful only."""
    if tag in DROPPED or tag in OUTSIDE and not in_article:
        return True, False
    doubtful = False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and value and re.search(r"display\s*:\s*none", value):
            return True, False
        if value and name in ("class", "id", "role") and tag not in ("html", "body"):
            # an id is one value, often the slug of a heading
            if name == "id" and (in_article or tag in TEXTUAL):
                continue
            words = [{w.lower() for w in _TOKEN.findall(v)} - ({"header"} if in_article else set()) for v in ([value] if name == "id" else value.split())]
            whole = [bool(w) and w <= NOISE for w in words]
            if any(whole) if in_article or tag in TEXTUAL else any(words) and all(w or not x for w, x in zip(whole, words)):
                return True, False
            doubtful = doubtful or not in_article and tag not in TEXTUAL and name != "id" and any(w & NOISE for w in words)
    return False, doubtful


class Lines(HTMLParser):
    """Blocks of text with their tag counts, region, and whether an article or main
    holds them; ``parent`` and ``kind`` give the region around each region (0 is the
    page) and its element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, bool, int, bool, bool]] = []    # (tag, dropped, region, in article, doubtful)
        self.doubtful: list[bool] = []                       # of each line
        self.parent, self.kind, self.part, self.tags = [0], [""], [], 0

    def _top(self) -> tuple[str, bool, int, bool, bool]:
        return self.open[-1] if self.open else ("", False, 0, False, False)

    def _break(self) -> None:
        text = " ".join("".join(self.part).split())
        if text:
            _, _, region, article, doubtful = self._top()
            self.lines.append((text, self.tags, region, article))
            self.doubtful.append(doubtful)
            self.tags = 0
        self.part = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._break()
            if self._top()[0] == "p":
                self.open.pop()                # a block ends an open paragraph
            if tag == "li" and any(t[0] == "li" for t in self.open):
                self._close("li", ("ul", "ol", "menu"))
        elif tag in ("br", "td", "th", "img", "wbr"):
            self.part.append("" if tag == "wbr" else " ")
        if tag in VOID or not (tag in BLOCKS or tag in DROPPED or tag == "td" or attrs):
            return
        _, dropped, region, article, doubtful = self._top()
        noise, doubt = noisy(tag, attrs, article)
        dropped, doubtful = dropped or noise, doubtful or doubt
        if tag in REGIONS:
            self.parent.append(region)
            self.kind.append(tag)
            region = len(self.parent) - 1
        article = article or not dropped and tag in ("article", "main")
        self.open.append((tag, dropped, region, article, doubtful and not article))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._top()[0] == tag and tag in DROPPED and tag not in self.CDATA_CONTENT_ELEMENTS:
            self.handle_endtag(tag)

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> bool:
        """Closes the nearest open ``tag``, unless one of ``within`` stands before it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return True
            if self.open[i][0] in within:
                return False
        return False

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._break()
        if tag in ("td", "th"):
            self.part.append(" ")
        # inline elements close within their block only, paragraphs within their container
        self._close(tag, tuple(REGIONS) if tag not in REGIONS and tag not in DROPPED else ())

    def handle_data(self, data: str) -> None:
        if not self._top()[1]:
            self.part.append(data)

    def finish(self, page: str) -> list[tuple[str, int, int, bool]]:
        self.feed(page)
        self.close()
        self._break()
        return self.lines


def smoothed(ratio: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """A Gaussian over neighbouring lines, renormalised at the ends."""
    weight = np.array([math.exp(-i * i / (2 * radius * radius)) for i in range(-radius, radius + 1)])
    total = np.convolve(ratio, weight, "full")[radius:radius + len(ratio)]
    return total / np.convolve(np.ones(len(ratio)), weight, "full")[radius:radius + len(ratio)]


def clusters(lines: list[tuple[str, int, int, bool]]) -> list[int]:
    """The lines whose smoothed ratio is above its spread (or the longest one)."""
    ratio = smoothed(np.array([len(text) * (PRIOR if article else 1) / max(1, tags) for text, tags, _, article in lines]))
    return np.flatnonzero(ratio >= ratio.std()).tolist() or [max(range(len(lines)), key=lambda i: len(lines[i][0]))]


def content(lines: list[tuple[str, int, int, bool]], parent: list[int], kind: list[str], doubtful: list[bool] | None = None) -> list[str]:
    """The lines of the content regions, in page order; doubtful ones only if they make
    up most of the clusters' text."""
    if not lines:
        return []
    above = clusters(lines)
    if doubtful is not None and any(doubtful):
        size = [0, 0]
        for i in above:
            size[doubtful[i]] += len(lines[i][0])
        if size[True] <= size[False]:
            lines = [x for x, d in zip(lines, doubtful) if not d]
            above = clusters(lines)
    weight = [0] * len(parent)                         # the clusters' characters directly in each region
    for i in above:
        weight[lines[i][2]] += len(lines[i][0])
    total, inner = weight[:], [[] for _ in parent]
    for r in range(len(parent) - 1, 0, -1):            # a region comes after the one around it
        total[parent[r]] += total[r]
        inner[parent[r]].append(r)
    whole, own, open_ = set(), set(), [0]              # regions kept whole, and those whose own lines only are
    while open_:
        r = open_.pop()
        if not total[r]:
            continue
        need, path = SHARE * total[r], [r]
        while (deeper := next((c for c in inner[r] if total[c] > need), None)) is not None:
            r = deeper
            path.append(r)
        if not inner[r] and len(path) > 1 and kind[path[-2]] not in ("", "body"):
            path.pop()                                 # a wrapper of one block: its siblings belong to it
        ends = next((k for k, x in enumerate(path) if kind[x] in ("article", "main")), len(path) - 1)
        whole.add(path[ends])
        for r, taken in zip(path[:ends], path[1:]):
            if weight[r]:
                own.add(r)
            open_ += [c for c in inner[r] if c != taken]
    for r in range(1, len(parent)):
        if parent[r] in whole:
            whole.add(r)
    return [text for text, _, r, _ in lines if r in whole or r in own]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = Lines()
    return "\n".join(content(found.finish(page), found.parent, found.kind, found.doubtful))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and its code points of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "html"):
            ids, urls, htmls = columns_of(b, "page_id", "url", "html")
            texts = [main_text(h) for h in htmls]
            yield rows_out(schema, ids, urls, texts, [len(t) for t in texts])

    return (pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
            .mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint"))
