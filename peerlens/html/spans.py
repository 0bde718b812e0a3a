"""Where the items of a filing stand in its raw HTML. All offsets are of the string as it was read."""

from __future__ import annotations

import re

from peerlens.html.toc import Entry

# What may follow the last item, in the order in which it is looked for.
_END_MARKERS = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        r"id\s*=\s*[\"']signatures[^\"']*[\"']",
        r"id\s*=\s*[\"']exhibits[^\"']*[\"']",
        r"id\s*=\s*[\"'][^\"']*cover[^\"']*[\"']",
        r">SIGNATURES<",
        r">\s*SIGNA\s*<.*?>\s*TURES\s*<",
    )
)
_PART = re.compile(r">\s*PART(?:\s|&nbsp;)+[IVXLC]+\b", re.IGNORECASE)
# A part heading counts only so far after an item's start and so near its end.
_PART_AFTER, _PART_BEFORE_END = 200, 12_000


class _Finder:
    def __init__(self, html: str, toc: list[Entry]):
        self.html, self.toc = html, toc
        self.anchors = {e.anchor: self.anchor(e.anchor) for e in toc if e.anchor}

    def tag(self, at: int, floor: int = 0) -> int:
        """The start of the tag that `at` lies in, or `at`."""
        opened = self.html.rfind("<", floor, at)
        return at if opened < 0 else opened

    def anchor(self, name: str, since: int = 0) -> int | None:
        m = re.compile(rf"(?:id|name)\s*=\s*['\"]{re.escape(name)}['\"]", re.IGNORECASE).search(self.html, since)
        return self.tag(m.start()) if m else None

    def anchor_of(self, e: Entry) -> int | None:
        return self.anchors.get(e.anchor) if e.anchor else None

    def heading(self, item: str, lo: int, hi: int) -> int | None:
        """The last "ITEM N" within the range: a mention in running text comes before the section's own heading."""
        shape = re.compile(rf"ITEM(?:\s|&nbsp;|&#160;|<[^>]+>){{0,20}}{re.escape(item)}(?:\b|[.:])", re.IGNORECASE)
        last = None
        for last in shape.finditer(self.html[lo:hi]) if hi > lo else ():
            pass
        return self.tag(lo + last.start(), lo) if last else None

    def end_marker(self, start: int) -> int:
        for shape in _END_MARKERS:
            if m := shape.search(self.html, start):
                return self.tag(m.start())
        return len(self.html)

    def start(self, i: int) -> int | None:
        e = self.toc[i]
        if e.anchor:
            return self.anchors[e.anchor]
        before = (self.anchor_of(x) for x in reversed(self.toc[:i]))
        after = (self.anchor_of(x) for x in self.toc[i + 1 :])
        lo = next((p for p in before if p is not None), 0)
        hi = next((p for p in after if p is not None), len(self.html))
        return self.heading(e.item, lo, hi)

    def end(self, i: int, start: int) -> int:
        mine = self.toc[i].anchor
        later = [x for x in self.toc[i + 1 :]]
        while later and mine and later[0].anchor == mine:
            later.pop(0)
        if not later:
            found = self.end_marker(start)
            return found if i == len(self.toc) - 1 else self.before_part(start, found)
        follows, found = later[0], len(self.html)
        if follows.anchor:
            p = self.anchor(follows.anchor, start)
            found = p if p is not None else found
        else:
            limit = next((p for x in later if (p := self.anchor_of(x)) is not None), len(self.html))
            p = self.heading(follows.item, start + 1, limit)
            found = limit if p is None else p
        return self.before_part(start, found)

    def before_part(self, start: int, end: int) -> int:
        """The end, or the start of a part heading shortly before it."""
        m = _PART.search(self.html, start, end) if end > start else None
        if not m or m.start() - start < _PART_AFTER or end - m.start() > _PART_BEFORE_END:
            return end
        return self.tag(m.start(), start)


def item_spans(html: str, toc: list[Entry]) -> dict[str, tuple[int, int]]:
    """Start and end of every item that can be found. An item whose anchor isn't in the filing is left out."""
    finder = _Finder(html, toc)
    out = {}
    for i, e in enumerate(toc):
        if (start := finder.start(i)) is not None:
            out[e.item] = (start, finder.end(i, start))
    return out


def inversions(toc: list[Entry], spans: dict[str, tuple[int, int]]) -> list[str]:
    """Items that stand before the one listed before them; their ends are unreliable."""
    starts = [(e.item, spans[e.item][0]) for e in toc if e.item in spans]
    return [b[0] for a, b in zip(starts, starts[1:]) if b[1] < a[1]]
