"""Main text of HTML pages by line-block distribution.

Markup is stripped so that each block of a page gives a line (see ``html``).  A
line weighs the characters of its text outside links; lines of menus, page headers,
footers, sidebars, notices, adverts, forms and reader comments weigh nothing and
are never kept and part no stretch.  Such parts are told by their element, or by a whole word of class, id or
role; a word does not count on headings, paragraphs, articles and main parts.  Nor
does it on what is wrapped around one, but for comments (where other text is marked), and for
articles outside a main part.  Where a page marks an article or main part, lines
outside weigh nothing and are not kept, and link text inside counts too.  Over the lines runs a window of ``WINDOW``
lines whose weights are summed.  A surge is where the sum rises from nothing, the
dive where it is nothing again: the lines in between, from the first to the last
that weighs something, are a stretch.  The stretches kept are those whose
highest sum reaches ``SURGE`` characters, or half the page's highest sum where that is
less; where an article is marked, all of them.  Of a shorter stretch those lines are kept, with what
is between them, that lie in a container with a kept stretch: directly, or as headings
anywhere below it (below body only directly).  Containers of a stretch are the innermost element
around most of its weight, and those right around its lines that weigh enough to be kept alone.

Null or empty html, and a page without text outside such parts, give an empty text.
A page is one row whatever its length.  Repeated rows give repeated results.  The
extraction is a column expression on html, so other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import Element, parsed
from .tables import free_name, long_texts, quoted, table

WINDOW = 3
SURGE = 86

# Elements and class, id or role words of parts that are not main text.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "fieldset", "search"}
#: Of these, elements that may be wrapped around a whole page.
WRAPS = {"form", "fieldset", "dialog", "header"}
COMMENTS = {
    "comment", "comments", "commentlist", "comment-list", "comments-list", "comments-area", "comments-section",
    "comment-section", "comment-respond", "comment-form", "disqus", "disqus-thread", "replies", "reply", "respond",
}
MARKS = COMMENTS | {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "advertising", "adsense", "adslot", "alert",
    "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "footer", "form", "gdpr", "hidden", "menu", "menubar", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "outbrain", "pager", "pagination", "paywall", "popup",
    "promo", "promotion", "related", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "taboola", "tags", "toc", "toolbar", "topbar", "widget", "widgets",
    # Compounds
    "ad-banner", "ad-box", "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "adsbygoogle", "banner-ad",
    "breadcrumb-trail", "consent-banner", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice",
    "footer-widgets", "gdpr-banner", "left-sidebar", "main-menu", "main-nav", "main-navigation", "nav-bar",
    "nav-links", "nav-menu", "newsletter-form", "newsletter-signup", "notification-bar", "page-footer",
    "post-navigation", "post-tags", "primary-sidebar", "related-articles", "related-links", "related-posts",
    "right-sidebar", "search-bar", "search-box", "search-form", "share-bar", "share-buttons", "share-links",
    "sharing-buttons", "side-bar", "sidebar-left", "sidebar-right", "signup-form", "site-footer", "site-nav",
    "site-navigation", "skip-link", "skip-links", "skip-nav", "social-buttons", "social-icons", "social-links",
    "social-share", "sponsored-content", "subscribe-form", "tag-list", "tags-links", "toc-container", "widget-area",
}
#: No mark counts on these.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
TEXT = {"html", "body", "p"} | HEADINGS
#: Elements that hold the lines of a text together.
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "td", "details"}


class Place:
    """What holds for the lines in an element, by the elements around it."""

    __slots__ = ("aside", "container", "depth", "first", "heading", "in_main", "inside", "inside_main", "jump", "last", "of_comments", "parent", "whole")

    def __init__(self, e: Element, parent: Place | None) -> None:
        self.parent = parent
        up = parent or self
        self.depth = parent.depth + 1 if parent else 0
        # Jumps that let any place above be found in a few steps.
        self.jump = up.jump.jump if parent and up.depth - up.jump.depth == up.jump.depth - up.jump.jump.depth else up
        self.inside_main = e.is_main or bool(parent and parent.inside_main)
        self.in_main = self.inside = self.inside_main or e.name == "article" or bool(parent and parent.in_main)
        self.of_comments = bool(parent and parent.of_comments) or bool(
            e.words & COMMENTS and e.name not in TEXT and not (e.is_main or e.holds_main)
        )
        self.heading = e.name in HEADINGS or bool(parent and parent.heading)
        self.container = self if e.name in CONTAINERS or not parent else parent.container
        self.aside = self.whole = False
        self.first = self.last = -1


def _is_aside(e: Element, at: Place, main: bool, article: bool) -> bool:
    """Whether the element itself is an aside.  ``main``: the page has a main part; ``article``: it has a main
    part or article that is not of comments."""
    if e.is_main or e.holds_main:
        return False
    if e.name in ASIDE or e.name == "header" and not at.inside:
        return not (e.holds_article and e.name in WRAPS)
    if e.name == "article" or e.holds_article:
        # Comments may be articles, and so may teasers in a sidebar beside the main part.
        if e.words & COMMENTS and article:
            return True
        marked = e.name != "article" and (e.hidden or e.words & MARKS)
        return bool(marked and main and not at.inside_main and e.name not in TEXT)
    return bool(e.hidden and e.name not in ("html", "body") or e.words & MARKS and e.name not in TEXT)


def stretches(weights: list[int], least: float) -> list[tuple[int, int]]:
    """[first, end) of the stretches between surge and dive whose highest window sum is
    above ``least``."""
    w = np.asarray(weights, np.int64)
    if not len(w):
        return []
    full = np.concatenate([np.zeros(WINDOW - 1, np.int64), w, np.zeros(WINDOW - 1, np.int64)])
    sums = np.convolve(full, np.ones(WINDOW, np.int64), "valid")  # sums[i + WINDOW - 1]: lines i..i + WINDOW - 1
    up = np.flatnonzero((sums > 0) & (np.concatenate([[0], sums[:-1]]) == 0))
    down = np.flatnonzero((sums > 0) & (np.concatenate([sums[1:], [0]]) == 0)) + 1
    found = []
    for a, b in zip(up, down, strict=True):
        if sums[a:b].max() > least:
            # The first window with text ends in its first line, the last one begins in its last.
            found.append((int(a), int(b - WINDOW + 1)))
    return found


def _joined(
    at: list[Place], places: list[tuple[Element, Place]], weights: list[int], kept: list[tuple[int, int]], least: float
) -> list[tuple[int, int]]:
    """[first, end) of what shorter stretches have in containers of ``kept`` ones."""
    if not kept:
        return []
    total = np.concatenate([[0], np.cumsum(weights)])
    for i, p in enumerate(at):
        p.first, p.last = (i if p.first < 0 else p.first), i
    for _, p in reversed(places[1:]):
        if p.first >= 0:
            up = p.parent
            up.first, up.last = (p.first if up.first < 0 else min(up.first, p.first)), max(up.last, p.last)
    shared: set[Place] = set()
    for a, b in kept:
        shared.update(at[i].container for i in range(a, b) if weights[i] > least)
        half = (total[b] - total[a]) / 2

        def most(p: Place, a: int = a, b: int = b, half: float = half) -> bool:
            return total[min(b, p.last + 1)] - total[max(a, p.first)] > half

        # What holds more than half of the weight holds the line in the middle of it.
        p = at[int(np.searchsorted(total, total[a] + half, "right")) - 1]
        while not most(p):
            p = p.parent if most(p.jump) else p.jump
        shared.add(p.container)
    for e, p in places[1:]:
        p.whole = p.parent.whole or (p in shared and e.name not in ("html", "body"))
    found, known = [], set(kept)
    for a, b in stretches(weights, 0):
        if (a, b) not in known:
            near = [i for i in range(a, b) if weights[i] and (at[i].container in shared or at[i].heading and at[i].whole)]
            if near:
                found.append((near[0], near[-1] + 1))
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    got, elements = parsed(page)
    of: dict[Element, Place] = {}
    for e in elements:
        of[e] = Place(e, of.get(e.parent))
    lines = [(x, of[x.at]) for x in got]
    has_main = any(p.inside_main for _, p in lines)
    has_article = any(p.in_main and not p.of_comments for _, p in lines)
    for e, p in of.items():
        p.aside = bool(p.parent and p.parent.aside) or _is_aside(e, p, has_main, has_article)
    lines = [(x, p) for x, p in lines if not p.aside]
    marked = any(p.in_main for _, p in lines)
    if marked:
        weights = [len(x.text) if p.in_main else 0 for x, p in lines]
    else:
        weights = [max(0, len(x.text) - x.link_chars) for x, _ in lines]
    sums = np.convolve(weights, np.ones(WINDOW, np.int64)) if weights else [0]
    least = 0 if marked else min(SURGE - 1, max(sums) / 2)
    kept = stretches(weights, least)
    if not marked:
        kept = sorted(kept + _joined([p for _, p in lines], list(of.items()), weights, kept, least))
    return "\n".join(lines[i][0].text for a, b in kept for i in range(a, b) if lines[i][1].in_main or not marked)


def _texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in parts:
        yield pa.array([main_text(p.as_py()) for p in pages], pa.string())


def article(html: Column) -> Column:
    long_texts(SparkSession.active())
    return F.arrow_udf(_texts, T.StringType(), F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(html)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars, in the place of columns of these names."""
    text = free_name(pages, "text")
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    return pages.withColumn(text, article(F.col("html"))).select(
        *[quoted(c) for c in kept], F.col(text).alias("text"), F.char_length(text).cast("long").alias("n_chars")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
