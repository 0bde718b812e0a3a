"""Tables of contents: from a filing's HTML to its items, in order, with anchors and titles.

A cascade of sources, from the most to the least reliable: the table near the marker, the links near the marker, the
links of the first part, the links of the whole filing, and, if there is a marker, the headings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from peerlens.functions import forms
from peerlens.html.dom import Node, parse
from peerlens.html.text import clean_toc as clean

_MARKER = re.compile(r"table\s+of\s+contents|index\s+to\s+financial\s+statements", re.IGNORECASE)
# Where a marker may stand, what is read around it, and what is read without one.
_MARKER_LIMIT, _BEFORE, _REGION, _PREFIX = 4_000_000, 3_000, 260_000, 800_000
# Phrases of a table of contents.
_INDICATORS = ("table of contents", "index to financial statements", "item 1.", "item 1a", "part i", "part ii", "item 1 ")
_PAIR = re.compile(forms.PAIR)
_SEVERAL = tuple(map(re.compile, forms.SEVERAL))
_SINGLE = tuple(re.compile(p, re.IGNORECASE) for p in forms.SINGLE)
_GLUED = re.compile(forms.GLUED)


@dataclass
class Entry:
    item: str
    anchor: str | None
    title: str


Toc = dict[str, Entry]


def item_numbers(text: str) -> list[str]:
    """All item numbers of a line, each once, in the order of the forms they are looked for in."""
    low = text.lower()
    found = list(m.groups()) if (m := _PAIR.search(low)) else []
    for shape in _SEVERAL:
        found += shape.findall(low)
    return list(dict.fromkeys(x.upper() for x in found))


def item_number(text: str, compat: bool = False) -> str | None:
    """The single item number of a line. A glued number as in "1ARisk" takes its letter only if a capitalised word
    follows; with compat the forms back-track, so that "1Business" is 1B."""
    for i, shape in enumerate(_SINGLE):
        if i == 1 and not compat:
            if m := _GLUED.match(text):
                return m[1].upper()
            continue
        if m := shape.search(text):
            return m[1].upper()
    return None


def numbers_of(text: str) -> list[str]:
    return item_numbers(text) or [x for x in [item_number(text)] if x]


def clean_title(text: str) -> str:
    """Without the page number at its end."""
    text = re.sub(r"\s+\d+\s*\Z", "", text)
    return re.sub(r"\d+\s*\Z", "", re.sub(r"\.\s*\d+\s*\Z", ".", text)).strip()


def fragment(href: str | None) -> str | None:
    return href.split("#", 1)[1].split("#")[0] or None if href and "#" in href else None


def _merge(base: Toc, extra: Toc) -> Toc:
    """Adds what base lacks, at its end; gives anchors and titles to entries without anchor."""
    for item, e in extra.items():
        if item not in base:
            base[item] = e
        elif not base[item].anchor and e.anchor:
            base[item] = Entry(item, e.anchor, e.title or base[item].title)
    return base


def _anchored(toc: Toc) -> int:
    return sum(1 for e in toc.values() if e.anchor)


def best_table(root: Node) -> Node | None:
    """The table with most items among those that look like a table of contents; the first of equals."""
    best, most = None, -1
    for t in root.find_all("table"):
        text = clean(t.text()).lower()
        n = len(re.findall(r"item\s+\d+[a-z]?", text))
        likely = n >= 2 or any(x in text for x in _INDICATORS)
        if likely and (n >= 3 or t.find("a")) and n > most:
            best, most = t, n
    return best


def from_table(t: Node) -> Toc:
    toc: Toc = {}
    for row in t.find_all("tr"):
        text = clean(row.text())
        anchor = next((f for a in row.find_all("a") if (f := fragment(a.attrs.get("href")))), None) or row.attrs.get("id") or None
        title = clean_title(text)
        for n in numbers_of(text):
            if not (n in toc and toc[n].anchor):
                toc[n] = Entry(n, anchor, title if 0 < len(title) <= 240 else f"Item {n}")
    return toc


def from_links(root: Node) -> Toc:
    """Items of linked lines: the nearest row, cell, list item, paragraph or division (in that order) with an item
    number gives number and title; the first link of an item counts."""
    toc: Toc = {}
    for a in root.find_all("a"):
        anchor = fragment((a.attrs.get("href") or "").strip())
        if not anchor:
            continue
        own, numbers, context = clean(a.text(" ")), [], ""
        for name in ("tr", "td", "li", "p", "div"):
            if (box := a.above(name)) and (text := clean(box.text(" "))) and (numbers := numbers_of(text)):
                context = text
                break
        if not context:
            box = a.above("tr", "td", "li", "p", "div")
            context = clean(box.text(" ")) if box else own
            numbers = item_numbers(context) or [x for x in [item_number(own)] if x]
        title = clean_title(context if 0 < len(context) <= 250 else own)
        for n in numbers:
            if not (n in toc and toc[n].anchor):
                toc[n] = Entry(n, anchor, title)
    return toc


def from_headings(root: Node, blocks: int = 200, most: int = 20) -> Toc:
    """Items of the first headings and paragraphs, with the id, name or nearby named link as anchor."""
    toc: Toc = {}
    named: Node | None = None
    seen = 0
    for node in root.walk():
        if node.name == "a" and node.attrs.get("name"):
            named = node
        if node.name not in ("h1", "h2", "h3", "h4", "p", "div"):
            continue
        seen += 1
        if seen > blocks or len(toc) >= most:
            break
        text = clean(node.text())
        if not (n := item_number(text)):
            continue
        inner = node.find("a")
        near = named if named and abs(node.line - named.line) < 10 else None
        anchor = node.attrs.get("id") or node.attrs.get("name") or (inner and (inner.attrs.get("name") or inner.attrs.get("id"))) or (near and near.attrs["name"])
        if not (n in toc and toc[n].anchor):
            toc[n] = Entry(n, anchor or None, clean_title(text))
    return toc


def region(html: str) -> str | None:
    """What surrounds the first marker; None without one near the start."""
    m = _MARKER.search(html)
    return html[max(0, m.start() - _BEFORE) : m.start() + _REGION] if m and m.start() <= _MARKER_LIMIT else None


def parse_toc(html: str) -> list[Entry] | None:
    """The items of a filing in the order of its table of contents; None if none is found."""
    near = region(html)
    root = parse(near if near is not None else html[:_PREFIX])
    links = from_links(root)
    prefix: Toc | None = None

    def broad() -> Toc:
        nonlocal prefix
        if prefix is None:
            prefix = from_links(parse(html[:_PREFIX]))
        return prefix

    if (t := best_table(root)) and len(toc := from_table(t)) >= 2 and _anchored(_merge(toc, links)) >= 2:
        return list(_merge(toc, broad()).values())
    if _anchored(links) >= 5:
        return list(_merge(links, broad()).values())
    if _anchored(broad()) >= 5:
        return list(broad().values())
    if len(html) > _PREFIX and _anchored(whole := from_links(parse(html))) >= 5:
        return list(whole.values())
    if near is not None and len(toc := from_headings(root)) >= 2:
        return list(toc.values())
    return None
