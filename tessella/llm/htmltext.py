"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The streaming standard-library parser turns a page into lines, one for each block-level stretch of text. A line's ratio is its
characters per tag in it. Ratios are smoothed with a Gaussian; lines above the page's spread (standard deviation) form the content
cluster. Each article or main element holds some of the cluster's characters; the innermost with most of them is the content region, and all
its lines count, short ones between long ones too. Where none has most of them (no such element, or several articles), any container (div,
section, td, body) with nearly all of the cluster is the region, or else the page; there a line counts if it is of the cluster by its
own ratio too, or if at least half of the text directly in its innermost container is of the cluster.

Ratios can't tell a reader's comment or a long notice from the article, so these are known by what the page calls them: elements (menus, footers,
sidebars, forms, headers outside the article), ARIA roles, and classes and ids of containers (div, section, list, table). They
are left out of ratios and result. Headings, paragraphs and inline elements stay whatever their class or id.

Null or empty html, or no content: empty text. Broken markup is read as far as the parser gets, pages of any length whole. An empty
table gives no rows. Repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import LenientParser, map_rows, read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source audio video".split())
DROPPED = frozenset("script style noscript template head title svg math iframe object canvas map select option textarea button datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search fieldset".split())
REGIONS = frozenset(("article", "main"))
CONTAINERS = REGIONS | frozenset("div section td body center ul ol dl table".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar sidebars nav navbar navigation menu menus breadcrumb "
    "breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay share sharing social related recommended "
    "comment comments commentlist disqus replies reply responses footer header masthead topbar toolbar widget widgets pagination pager login search alert".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements whose class or id may name a boilerplate part.
NAMED = frozenset("div section ul ol dl table tbody tr td center details figure iframe".split())
_SPLIT = re.compile(r"[\s_\-]+")


def _named(value: str, inside: bool) -> bool:
    """Whether a class or id names a boilerplate part, whole or by its first or last word (`cookie-bar`, `site-footer`). Inside an article a
    header is its own."""
    for name in value.lower().split():
        parts = _SPLIT.split(name)
        if inside and "header" in parts:
            continue
        if name in NAMES or parts[-1] in NAMES or (parts[0] in NAMES and parts[0] not in ("header", "nav", "menu", "search", "alert", "banner")):
            return True
    return False


class LineParser(LenientParser):
    """Lines as (text, tags, container): the innermost open container. Containers are numbered as they open, 0 being the page; `parents` holds the container
    around each, `regions` whether it is an article or main element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, str]] = []  # element and what it does: "" nothing, "x" drop, "r" region, "c" other container
        self.open: Counter = Counter()
        self.off, self.container, self.open_regions = 0, 0, 0
        self.parents, self.regions = [0], [False]
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.container))
        self.parts, self.tags = [], 0

    def kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in DROPPED or tag in BOILERPLATE:
            return "x"
        if tag == "header" and not self.open_regions:
            return "x"
        if tag not in ("body", "html"):
            for k, v in attrs:
                if k == "hidden" or v and (k == "role" and v.lower() in ROLES or k in ("class", "id") and tag in NAMED and _named(v, self.open_regions > 0) or k == "aria-hidden" and v == "true"):
                    return "x"
                if v and tag in REGIONS and k in ("class", "id") and any(n in ("comment", "comments", "related", "ad", "advert", "sponsored", "promo", "teaser", "reply") for n in _SPLIT.split(v.lower())):
                    return "x"
        return "r" if tag in REGIONS else "c" if tag in CONTAINERS else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P and any(t == "p" for t, _ in self.stack[-8:]):
            self.close_to("p", within=CLOSES_P)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.stack and self.stack[-1][0] == tag:
            self.close_to(tag)
        if tag in INLINE:
            if not self.off:
                self.tags += 1
                if tag == "br":
                    self.parts.append(" ")
        else:
            self.flush()
        if tag in VOID:
            return
        what = self.kind(tag, attrs)
        if what == "x":
            if tag in INLINE and not self.off:
                self.parts.append(" ")
            self.off += 1
        elif what:
            self.parents.append(self.container)
            self.regions.append(what == "r")
            self.container = len(self.parents) - 1
            self.open_regions += what == "r"
        self.stack.append((tag, what))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_to(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open `tag`, if it is open; with `within`, only through elements that aren't in it."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                break
            if self.stack[i][0] in within:
                return
        self.flush()
        self.drop(i)

    def drop(self, i: int) -> None:
        """Close the elements from the i-th open one on."""
        for tag, what in reversed(self.stack[i:]):
            self.open[tag] -= 1
            self.off -= what == "x"
            if what in ("r", "c"):
                self.container = self.parents[self.container]
            self.open_regions -= what == "r"
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.tags += not self.off
            if not self.open[tag]:
                return
            for i in range(len(self.stack) - 1, -1, -1):  # an inline element closes only what it opened inside the same block
                if self.stack[i][0] == tag:
                    if all(t in INLINE for t, _ in self.stack[i:]):
                        self.drop(i)
                    return
                if self.stack[i][0] not in INLINE:
                    return
        elif tag not in VOID:
            self.flush()
            self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.off:
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self.flush()


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing with a kernel of two sigmas to each side, renormalised at the ends."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[j - i + radius], values[j]) for j in range(max(0, i - radius), min(len(values), i + radius + 1))]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def main_lines(html: str, sigma: float = 1.0, share: float = 0.6, nearly_all: float = 0.9) -> list[str]:
    """The content lines of a page. `share`: how much of the content cluster an article or main element must hold to be chosen over what is
    around it; `nearly_all`: the same of other containers, which may be parts of the content as well as its whole."""
    parser = LineParser()
    parser.read(html)
    lines, parents = parser.lines, parser.parents
    if not lines:
        return []
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _ in lines], sigma)
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    threshold = min(spread, max(ratios))
    cluster = [r >= threshold for r in ratios]
    held, own = [0] * len(parents), [0] * len(parents)
    for (text, _, place), content in zip(lines, cluster, strict=True):
        held[place] += len(text) if content else 0
        own[place] += len(text) if content else -len(text)
    for c in range(len(parents) - 1, 0, -1):  # what is inside has greater numbers
        held[parents[c]] += held[c]
    total = held[0]
    region = max((c for c, r in enumerate(parser.regions) if r and 0 < held[c] >= share * total), default=0)  # the innermost of those that hold most of the cluster
    chosen = region or max((c for c in range(1, len(parents)) if 0 < held[c] >= nearly_all * total), default=0)
    inside = [not chosen] * len(parents)
    for c in range(1, len(parents)):
        inside[c] = c == chosen or inside[parents[c]]
    if region:
        return [text for text, _, place in lines if inside[place]]
    out = []
    for (text, tags, place), content in zip(lines, cluster, strict=True):
        if inside[place] and (content and len(text) / max(1, tags) >= threshold or own[place] >= 0):
            out.append(text)
    return out


def main_text(html: str | None) -> str:
    return "\n".join(main_lines(html)) if html else ""


def extract_main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    def work(batches: Iterator[list[list]]):
        for keys, urls, pages in batches:
            texts = [main_text(p.as_py()) for p in pages]
            yield [keys, urls, texts, [len(t) for t in texts]]

    return map_rows(df, [key, url, html], work, "page_id long, url string, text string, n_chars long", arrow=True)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(read(spark, sf_dir, "pages"))
