"""Main text of web pages from flat text blocks.

A page becomes its text blocks in page order, each with its words, the share
of words inside links, the same of its neighbours, and what its container says
(article, boilerplate, neither). A decision tree (CART, Gini) trained on the
small table of labelled blocks below keeps or drops each. The container decides
where the page marks its article; elsewhere own and neighbours' words and links
do: a linked line between paragraphs is text, a short line between menus isn't.

A class, id or role marks boilerplate only when all parts of one of its names
are known (``ad-box``, ``cookie-notice``); names that merely hold such a part
(``related-work``, ``share-price``) say nothing.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "article", "boilerplate", "page_has_article", "heading")

#: Labelled blocks: the features above, then 1 for main text. Links are shares; article, boilerplate, page_has_article and heading are 0 or 1.
LABELLED = [
    # inside an article: text of any length, also beside links and short lines
    (85, 0.00, 60, 0.00, 70, 0.00, 1, 0, 1, 0, 1), (40, 0.05, 90, 0.00, 12, 0.00, 1, 0, 1, 0, 1), (12, 0.00, 45, 0.00, 50, 0.10, 1, 0, 1, 0, 1), (3, 0.00, 30, 0.00, 80, 0.00, 1, 0, 1, 0, 1),
    (1, 0.00, 120, 0.00, 60, 0.00, 1, 0, 1, 0, 1), (1, 0.00, 2, 0.00, 3, 0.00, 1, 0, 1, 0, 1), (7, 0.00, 8, 0.00, 25, 0.00, 1, 0, 1, 1, 1), (9, 0.00, 6, 1.00, 33, 0.00, 1, 0, 1, 1, 1),
    (4, 0.00, 90, 0.00, 110, 0.00, 1, 0, 1, 1, 1), (160, 0.30, 14, 0.00, 9, 0.00, 1, 0, 1, 0, 1), (22, 0.50, 70, 0.00, 64, 0.00, 1, 0, 1, 0, 1), (2, 1.00, 80, 0.00, 75, 0.00, 1, 0, 1, 0, 1),
    (6, 0.00, 0, 0.00, 0, 0.00, 1, 0, 1, 0, 1), (500, 0.01, 9, 0.00, 14, 0.20, 1, 0, 1, 0, 1), (18, 0.00, 5, 1.00, 7, 0.00, 1, 0, 1, 0, 1), (30, 0.10, 1, 1.00, 12, 0.00, 1, 0, 1, 0, 1),
    (5, 1.00, 40, 0.00, 5, 1.00, 1, 0, 1, 0, 1), (11, 0.90, 36, 0.00, 28, 0.00, 1, 0, 1, 0, 1), (2, 0.00, 1, 0.00, 1, 0.00, 1, 0, 1, 1, 1), (64, 0.00, 200, 0.00, 0, 0.00, 1, 0, 1, 0, 1),
    # inside an article beside links, and the same outside it
    (85, 0.00, 60, 0.00, 5, 1.00, 1, 0, 1, 0, 1), (30, 0.00, 120, 0.00, 2, 1.00, 1, 0, 1, 0, 1), (45, 0.10, 40, 0.00, 8, 0.90, 1, 0, 1, 0, 1), (3, 1.00, 50, 0.00, 3, 1.00, 1, 0, 1, 0, 1),
    (25, 0.00, 2, 1.00, 2, 1.00, 1, 0, 1, 0, 1), (70, 0.00, 44, 0.00, 1, 1.00, 1, 0, 1, 0, 1), (33, 0.00, 3, 1.00, 12, 0.60, 1, 0, 1, 0, 1), (2, 1.00, 4, 1.00, 6, 0.00, 1, 0, 1, 0, 1),
    (85, 0.00, 60, 0.00, 4, 1.00, 0, 0, 1, 0, 0), (30, 0.00, 50, 0.00, 3, 1.00, 0, 0, 1, 0, 0), (24, 0.00, 90, 0.00, 2, 1.00, 0, 0, 1, 0, 0), (40, 0.05, 12, 0.00, 6, 0.80, 0, 0, 1, 0, 0),
    (26, 0.00, 2, 1.00, 4, 1.00, 0, 0, 1, 0, 0), (55, 0.00, 8, 0.00, 1, 1.00, 0, 0, 1, 0, 0),
    # boilerplate containers inside an article: comments, adverts, shares, forms, notices
    (25, 0.00, 80, 0.00, 30, 0.00, 1, 1, 1, 0, 0), (60, 0.02, 90, 0.00, 45, 0.00, 1, 1, 1, 0, 0), (3, 1.00, 100, 0.00, 3, 1.00, 1, 1, 1, 0, 0), (8, 0.00, 50, 0.00, 70, 0.00, 1, 1, 1, 0, 0),
    (120, 0.00, 40, 0.00, 12, 0.00, 1, 1, 1, 0, 0), (2, 0.00, 200, 0.00, 18, 0.00, 1, 1, 1, 1, 0), (14, 0.50, 33, 0.00, 6, 1.00, 1, 1, 1, 0, 0),
    # outside the article of a page that has one
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 1, 0, 0), (2, 1.00, 1, 1.00, 2, 1.00, 0, 1, 1, 0, 0), (4, 1.00, 0, 0.00, 3, 1.00, 0, 1, 1, 0, 0), (9, 0.00, 1, 1.00, 8, 0.00, 0, 1, 1, 0, 0),
    (14, 0.10, 60, 0.00, 0, 0.00, 0, 1, 1, 0, 0), (75, 0.00, 40, 0.00, 50, 0.00, 0, 1, 1, 0, 0), (30, 0.00, 12, 0.00, 22, 0.00, 0, 0, 1, 0, 0), (90, 0.00, 70, 0.00, 10, 0.30, 0, 0, 1, 0, 0),
    (5, 0.00, 3, 1.00, 40, 0.00, 0, 0, 1, 0, 0), (6, 1.00, 8, 1.00, 9, 1.00, 0, 0, 1, 0, 0), (3, 0.00, 55, 0.00, 20, 0.00, 0, 0, 1, 1, 0), (18, 0.30, 4, 1.00, 33, 0.00, 0, 0, 1, 0, 0),
    (2, 0.00, 9, 0.00, 1, 1.00, 0, 1, 1, 1, 0), (45, 0.05, 0, 0.00, 7, 0.00, 0, 1, 1, 0, 0), (12, 0.00, 20, 0.00, 0, 0.00, 0, 0, 1, 0, 0), (200, 0.00, 3, 0.00, 5, 0.00, 0, 0, 1, 0, 0),
    # pages without an article element: text density and links decide
    (80, 0.00, 60, 0.00, 55, 0.00, 0, 0, 0, 0, 1), (35, 0.05, 90, 0.00, 44, 0.00, 0, 0, 0, 0, 1), (22, 0.10, 30, 0.00, 50, 0.00, 0, 0, 0, 0, 1), (150, 0.20, 5, 0.00, 3, 1.00, 0, 0, 0, 0, 1),
    (4, 0.00, 60, 0.00, 80, 0.00, 0, 0, 0, 0, 1), (1, 0.00, 40, 0.00, 90, 0.00, 0, 0, 0, 0, 1), (7, 0.00, 2, 1.00, 65, 0.00, 0, 0, 0, 1, 1), (6, 0.00, 45, 0.00, 70, 0.00, 0, 0, 0, 1, 1),
    (9, 0.00, 8, 0.00, 60, 0.00, 0, 0, 0, 1, 1), (18, 0.00, 9, 0.00, 40, 0.00, 0, 0, 0, 0, 1), (13, 0.00, 33, 0.00, 16, 0.00, 0, 0, 0, 0, 1), (60, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (16, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1), (12, 0.00, 10, 0.00, 11, 0.00, 0, 0, 0, 0, 1), (3, 0.00, 12, 0.00, 30, 0.00, 0, 0, 0, 0, 1), (5, 0.00, 30, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (8, 0.00, 7, 0.00, 9, 0.00, 0, 0, 0, 0, 1), (2, 0.00, 6, 0.00, 5, 0.00, 0, 0, 0, 1, 1), (25, 0.45, 60, 0.00, 55, 0.00, 0, 0, 0, 0, 1), (4, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0, 0), (3, 1.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0, 0), (6, 0.90, 5, 1.00, 3, 1.00, 0, 0, 0, 0, 0), (12, 0.80, 9, 0.90, 60, 0.00, 0, 0, 0, 0, 0),
    (20, 0.75, 40, 0.00, 15, 0.90, 0, 0, 0, 0, 0), (2, 1.00, 80, 0.00, 2, 1.00, 0, 0, 0, 0, 0), (5, 0.70, 0, 0.00, 4, 1.00, 0, 0, 0, 0, 0), (3, 1.00, 50, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    # linked lines between paragraphs, and short lines between links
    (12, 1.00, 40, 0.00, 35, 0.00, 0, 0, 0, 0, 1), (6, 1.00, 85, 0.00, 60, 0.05, 0, 0, 0, 0, 1), (9, 0.80, 22, 0.00, 41, 0.00, 0, 0, 0, 0, 1), (15, 0.95, 130, 0.10, 18, 0.00, 0, 0, 0, 0, 1),
    (4, 1.00, 33, 0.00, 90, 0.00, 0, 0, 0, 0, 1), (20, 0.70, 55, 0.00, 70, 0.00, 0, 0, 0, 0, 1), (8, 1.00, 25, 0.00, 28, 0.00, 0, 0, 0, 0, 1), (30, 0.75, 16, 0.00, 17, 0.00, 0, 0, 0, 0, 1),
    (1, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 0), (2, 0.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0, 0), (4, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0, 0), (3, 0.00, 5, 1.00, 1, 1.00, 0, 0, 0, 0, 0),
    (5, 0.00, 2, 1.00, 6, 0.90, 0, 0, 0, 0, 0), (2, 0.00, 4, 0.80, 2, 1.00, 0, 0, 0, 0, 0), (3, 0.30, 2, 1.00, 2, 1.00, 0, 0, 0, 0, 0), (1, 0.00, 6, 1.00, 5, 1.00, 0, 0, 0, 1, 0),
    (40, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 1), (90, 0.00, 1, 1.00, 4, 1.00, 0, 0, 0, 0, 1), (25, 0.10, 3, 1.00, 2, 1.00, 0, 0, 0, 0, 1),
    (4, 1.00, 2, 1.00, 60, 0.00, 0, 0, 0, 0, 0), (2, 1.00, 90, 0.00, 3, 1.00, 0, 0, 0, 0, 0), (6, 0.90, 1, 1.00, 30, 0.00, 0, 0, 0, 0, 0), (8, 1.00, 45, 0.00, 7, 1.00, 0, 0, 0, 0, 0),
    (3, 1.00, 0, 0.00, 40, 0.00, 0, 0, 0, 0, 0), (2, 1.00, 70, 0.00, 0, 0.00, 0, 0, 0, 0, 0), (3, 1.00, 4, 0.00, 6, 0.00, 0, 0, 0, 0, 0), (2, 1.00, 9, 0.00, 3, 0.00, 0, 0, 0, 0, 0),
    # boilerplate containers on such pages
    (9, 0.00, 20, 0.00, 30, 0.00, 0, 1, 0, 0, 0), (40, 0.00, 60, 0.00, 25, 0.00, 0, 1, 0, 0, 0), (2, 1.00, 1, 1.00, 6, 0.00, 0, 1, 0, 0, 0), (100, 0.10, 30, 0.00, 70, 0.00, 0, 1, 0, 0, 0),
    (3, 0.00, 0, 0.00, 12, 0.00, 0, 1, 0, 1, 0), (15, 0.20, 0, 0.00, 1, 1.00, 0, 1, 0, 0, 0),
]

#: Elements whose content is no text; elements that hold boilerplate; elements inside a line (fixed values of HTML).
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "head", "title"}
BOILERPLATE = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "fieldset", "label", "legend", "option"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "semantics"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Parts of class and id names, and roles, that mark boilerplate.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "widget", "widgets", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter",
    "subscribe", "subscription", "signup", "login", "search", "popup", "modal", "overlay", "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer", "masthead", "topbar", "contentinfo", "complementary", "dialog", "teaser", "outbrain", "taboola", "feedback",
}
#: Parts of names that say nothing about the content of what they name.
NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "holder", "icons", "inner", "item", "items", "left", "links", "list", "main", "outer", "panel", "right", "row", "section", "site", "slot", "text", "title", "top", "unit", "wrap", "wrapper"}
_SPECIAL, _NAME_END = re.compile("[>\"']"), re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marks_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = {p.lower() for p in _PARTS.findall(one)}
                if parts & NAMES and parts <= NAMES | NEUTRAL or "header" in parts and parts <= NAMES | NEUTRAL | {"header"} and not in_article:
                    return tag not in ("body", "html", "article", "main")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return tag not in ("body", "html")
    return False


class Markup:
    """Comments, sections and tags of a page, found in time linear in its length however much of it is unfinished.

    Between a tag's name and its ``>``, quoted strings are passed over. Where
    that ends depends only on the next quote or ``>``, so it is worked out once
    for each of these, and searches that only move forward are not repeated.
    """

    def __init__(self, page: str):
        self.page, self.ends, self.ahead = page, {}, {}
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def next(self, pattern: re.Pattern, at: int) -> int:
        """The first match from ``at`` on, or the page's length; places come in rising order, but for steps back inside a name."""
        began, found = self.ahead.get(pattern, (0, -1))
        if not began <= at <= found:
            m = pattern.search(self.page, at)
            began, found = at, m.start() if m else len(self.page)
            self.ahead[pattern] = began, found
        return found

    def end(self, at: int) -> int:
        """Past the ``>`` that ends a tag whose attributes start at ``at``; 0 if none does."""
        passed, found = [], 0
        special = self.next(_SPECIAL, at)
        while special < len(self.page):
            if special in self.ends:
                found = self.ends[special]
                break
            passed.append(special)
            c = self.page[special]
            if c == ">":
                found = special + 1
                break
            close = self.page.find(c, special + 1) if special < self.last[c] else -1
            if close < 0:
                break
            m = _SPECIAL.search(self.page, close + 1)
            special = m.start() if m else len(self.page)
        self.ends.update(dict.fromkeys(passed, found))
        return found

    def tag(self, start: int) -> tuple[int, str, str, str] | None:
        """(end, slash, name, attributes) of the tag at a ``<``."""
        page, slash = self.page, self.page[start + 1 : start + 2] == "/"
        name = start + 1 + slash
        if not ("a" <= page[name : name + 1] <= "z" or "A" <= page[name : name + 1] <= "Z"):
            return None
        stop = self.next(_NAME_END, name + 1)
        end = self.end(stop)
        while not end:  # a name may have run into a quoted string
            stop = max(page.rfind('"', name + 1, stop), page.rfind("'", name + 1, stop))
            if stop < 0:
                return None
            end = self.ends.get(stop) or self.end(stop)
        return end, "/" if slash else "", page[name:stop], page[stop : end - 1]

    def __iter__(self):
        """(start, end, slash, name, attributes) in order; the name is empty for what is no tag."""
        page, at = self.page, self.page.find("<")
        while at >= 0:
            found = None
            for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(opens, at):
                    close = page.find(closes, at + len(opens))
                    found = len(page) if close < 0 else close + len(closes), "", "", ""
                    break
            if found is None and at < self.last[">"]:
                found = (page.find(">", at) + 1, "", "", "") if page[at + 1] in "!?" else self.tag(at)
            if found is not None:
                yield at, *found
            at = page.find("<", at + 1 if found is None else found[0])


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of a page's blocks and their features."""
    texts: list[str] = []
    facts: list[tuple] = []  # words, link words, article, boilerplate, heading
    stack: list[tuple[str, bool, bool]] = []  # tag, inside an article, inside boilerplate
    parts: list[str] = []
    linked = link = 0
    silent, at = "", 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, article, bad = stack[-1] if stack else ("", False, False)
            heading = any(re.fullmatch(r"h[1-6]", t) for t, _, _ in stack[-3:])
            texts.append(text)
            facts.append((len(text.split()), linked, article, bad, heading))
        linked = 0

    def add(raw_text: str) -> None:
        nonlocal linked
        text = html.unescape(raw_text)
        parts.append(text)
        if link:
            linked += len(text.split())

    for start, end, closing, name, attributes in Markup(page):
        if silent:
            if closing and name.lower() == silent:
                silent = ""
            at = end
            continue
        if start < at:  # inside what a silent element took
            continue
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            if page.startswith("<![CDATA[", start):
                parts.append(page[start + 9 : end].removesuffix("]]>"))
            continue
        tag = name.lower()
        if tag in SILENT:
            if tag not in INLINE:
                end_block()
            if not closing and not attributes.rstrip().endswith("/"):
                if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):  # content without markup of its own
                    stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    at = stop.end() if stop else len(page)
                elif tag != "head":
                    silent = tag
            continue
        if tag == "a":
            link = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            _, article, bad = stack[-1] if stack else ("", False, False)
            if not closing and tag not in VOID and not bad and attributes.strip() and marks_boilerplate(tag, attributes, article):
                end_block()
                stack.append((tag, article, True))
            elif not closing and stack and stack[-1][0] == tag:  # its end tag must not end the one around it
                stack.append((tag, article, bad))
            elif closing and stack and stack[-1][0] == tag:
                if not (len(stack) > 1 and stack[-2][0] == tag):
                    end_block()
                stack.pop()
            continue
        end_block()
        link = 0 if closing else link
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag == "p" and stack and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                stack.pop()  # its end tag may be left out
            _, article, bad = stack[-1] if stack else ("", False, False)
            role = re.search(r"role\s*=\s*[\"']?(main|article)\b|itemprop\s*=\s*[\"']?articleBody\b", attributes, re.I) if attributes.strip() else None
            article = article or tag in ("article", "main") or role is not None
            stack.append((tag, article, bad or marks_boilerplate(tag, attributes, article)))
    if not silent and at < len(page):
        add(page[at:])
    end_block()
    return texts, features(facts)


def features(facts: list[tuple]) -> np.ndarray:
    """The table of FEATURES from (words, link words, article, boilerplate, heading) in page order."""
    out = np.zeros((len(facts), len(FEATURES)))
    if not facts:
        return out
    f = np.array(facts, dtype=float)
    words, links = f[:, 0], f[:, 1] / np.maximum(f[:, 0], 1)
    out[:, 0], out[:, 1] = words, links
    out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
    out[:, 6], out[:, 7], out[:, 9] = f[:, 2], f[:, 3], f[:, 4]
    out[:, 8] = ((f[:, 2] > 0) & (f[:, 3] == 0)).any()
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A CART: ("leaf", label) or (feature, threshold, tree at or below, tree above); splits lower Gini impurity most, first ones win ties."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return ("leaf", int(y.mean() >= 0.5))
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean())
    best = (gini(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            impurity = gini(y[low]) + gini(y[~low])
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    if best[1] is None:
        return ("leaf", int(y.mean() >= 0.5))
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train(rows=None) -> tuple:
    table = np.array(LABELLED if rows is None else rows, dtype=float)
    return grow(table[:, :-1], table[:, -1])


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), bool(tree[1]))
    low = x[:, tree[0]] <= tree[1]
    return np.where(low, classify(tree[2], x), classify(tree[3], x))


def main_text(page: str, tree: tuple) -> tuple[str, int, int]:
    """Main text, blocks and blocks kept of a page."""
    texts, x = blocks(page)
    if not texts:
        return "", 0, 0
    keep = classify(tree, x)
    return "\n".join(t for t, k in zip(texts, keep) if k), len(texts), int(keep.sum())


def extract(pages: DataFrame, markup: str = "html", rows=None) -> DataFrame:
    """``pages`` without its markup, plus text, n_chars, n_blocks, n_kept.

    Null and empty pages give an empty text, as do pages of boilerplate only;
    markup that never ends is read to the end of the page. Every input row
    returns once, repeated rows too; columns named like the added ones are
    replaced. The labelled table can be replaced by ``rows``.
    """
    added = ["text", "n_chars", "n_blocks", "n_kept"]
    source = pages.withColumn("_page", F.coalesce(F.col(markup).cast("string"), F.lit(""))).drop(markup, *added)
    schema = source.drop("_page").schema.add("text", "string").add("n_chars", "long").add("n_blocks", "integer").add("n_kept", "integer")
    tree = train(rows)

    def run(batches):
        for batch in batches:
            found = [main_text(p, tree) for p in batch.column("_page").to_pylist()]
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_page"]
            columns += [pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int32()), pa.array([k for _, _, k in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
