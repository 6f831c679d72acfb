"""Lines of an HTML page: the text of each block, without markup.

A block element begins and ends a line.  Character references are decoded,
white space inside a line becomes one space.  Comments, scripts, styles and the
like have no text, nor have drawings and what stands in for objects; these end with the element around them
if they are not closed.  Formulas have text.  A quote opens a string only where a value begins.  Broken markup
(unclosed or stray tags) is read as it stands, in time in proportion to the page however deep it nests.
A link is an a with href.  It ends at its end tag, at the next a, or with the block around it;
where the next a comes before any end tag, it ends with the line.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([a-zA-Z_:][\w:.-]*)", re.S)
# Element names of the HTML standard.
RAW = {"script", "style", "iframe", "textarea", "title"}
#: Elements whose content is markup that is not shown.
UNSHOWN = {"noscript", "template", "object", "svg", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"button", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body"}
CLOSE = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
#: Attributes that hold addresses, and what markup that has one of them holds.
ADDRESSES = ("href", "src", "action", "poster", "data")
ADDRESS = re.compile("|".join(ADDRESSES), re.I)
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)


@dataclass(eq=False)
class Element:
    name: str
    parent: Element | None = None
    #: Words of class, id and role.
    words: frozenset[str] = frozenset()
    #: Marked as not shown.
    hidden: bool = False
    #: A main part is inside; an article is inside that lies in no other article below this element.
    holds_main: bool = False
    holds_article: bool = False

    @property
    def is_main(self) -> bool:
        return self.name == "main" or "main" in self.words


@dataclass
class Line:
    text: str
    link_chars: int
    #: The innermost open element.
    at: Element


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value, bare in ATTRIBUTE.findall(raw):
        value = value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1 else value
        found.setdefault((name or bare).lower(), html.unescape(value))
    return found


def tidy(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def lines(page: str) -> list[Line]:
    """All lines with text, in page order."""
    return parsed(page)[0]


def parsed(page: str) -> tuple[list[Line], list[Element]]:
    """All lines with text in page order, and all elements, outer ones first; the first stands for the page."""
    out: list[Line] = []
    root = Element("")
    elements, path = [root], [root]
    opened: Counter[str] = Counter()
    #: Place in the path of the outermost element that is not shown, or 0.
    unshown = 0
    parts: list[str] = []
    linked: list[str] = []
    at, end = 0, len(page)
    #: Open elements around the open link, or -1; whether it may go on over lines.
    link, closed = -1, False

    def flush() -> None:
        if parts:
            text = tidy(parts)
            if text:
                out.append(Line(text, len(tidy(linked)) if linked else 0, path[-1]))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text and not unshown:
            parts.append(text)
            if link >= 0:
                linked.append(text)

    def push(new: Element) -> None:
        elements.append(new)
        path.append(new)
        opened[new.name] += 1

    def pop() -> None:
        opened[path.pop().name] -= 1

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                link = -1
            if name in BLOCK or name in UNSHOWN:
                if opened[name]:
                    k = len(path) - 1
                    while path[k].name != name:
                        k -= 1
                else:
                    k = len(path)
                if name in BLOCK and not (unshown and k > unshown):
                    flush()
                while len(path) > k:
                    pop()
                if len(path) <= unshown:
                    unshown = 0
                if name in BLOCK and (len(path) - 1 < link or not closed):
                    link = -1
        elif name in RAW:
            close = CLOSE[name].search(page, at)
            if not m.group(3).rstrip().endswith("/"):
                at = close.end() if close else end
        elif name in UNSHOWN:
            if not m.group(3).rstrip().endswith("/"):
                push(Element(name, path[-1]))
                unshown = unshown or len(path) - 1
        elif name == "br":
            add(" ")
        elif name == "a":
            link = -1
            if "href" in attributes(m.group(3)):
                after = ANCHOR.search(page, at)
                link, closed = len(path) - 1, bool(after and after.group(1))
        elif name in BLOCK:
            if not unshown:
                flush()
            if name in ENDS_P and path[-1].name == "p":
                pop()
            if name == "li" and path[-1].name == "li":
                pop()
            if len(path) - 1 < link or not closed:
                link = -1
            if name not in VOID:
                found = attributes(m.group(3)) if m.group(3) else {}
                marks = " ".join(found.get(k, "") for k in ("class", "id", "role"))
                words = frozenset(marks.lower().replace("_", "-").split())
                push(Element(name, path[-1], words, "hidden" in found or found.get("aria-hidden") == "true"))
    flush()
    for e in reversed(elements[1:]):
        e.parent.holds_main |= e.is_main or e.holds_main
        e.parent.holds_article |= (e.name == "article" and not e.is_main) or (e.holds_article and e.name != "article")
    return out, elements


def links(page: str) -> list[tuple[str, str, str]]:
    """(element and attribute, address, text) of all links outside comments and scripts."""
    out: list[tuple[str, str, str]] = []
    at, open_link, start = 0, -1, 0
    for m in TOKEN.finditer(page):
        name = (m.group(2) or "").lower()
        if not name or m.start() < at:
            continue
        if name == "a" and open_link >= 0:
            kind, url, _ = out[open_link]
            out[open_link] = (kind, url, tidy([TOKEN.sub("", page[start : m.start()])]))
            open_link = -1
        if m.group(1):
            continue
        found = attributes(m.group(3)) if ADDRESS.search(m.group(3)) else {}
        for key in ADDRESSES if found else ():
            if found.get(key, "").strip():
                out.append((f"{name.upper()}@/{key}", found[key].strip(), found.get("alt", "") if name == "img" else ""))
                if name == "a" and key == "href":
                    open_link, start = len(out) - 1, m.end()
        if name in RAW and name != "iframe":
            close = CLOSE[name].search(page, m.end())
            at = close.end() if close else len(page)
    return out


def title(page: str) -> str:
    m = re.search(r"<title\b[^>]*>(.*?)(?:</title|\Z)", page, re.I | re.S)
    return tidy([m.group(1)]) if m else ""
