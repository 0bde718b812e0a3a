"""A small tolerant tree on the standard library's tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that close an open element of the listed names within the nearest boundary.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_BLOCKS = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element. children holds strings and nodes; line is where its tag stands."""

    __slots__ = ("name", "attrs", "children", "parent", "line")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None, line: int = 0):
        self.name, self.attrs, self.parent, self.line = name, attrs, parent, line
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find_all(self, *names: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.name in names)

    def find(self, *names: str) -> Node | None:
        return next(self.find_all(*names), None)

    def above(self, *names: str) -> Node | None:
        """The nearest ancestor of one of these names."""
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [*reversed(self.children)]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack += reversed(c.children)

    def text(self, between: str = "") -> str:
        return between.join(self.strings())

    def styles(self) -> str:
        """All style attributes of the element and what is below it, in lower case."""
        own = [self.attrs.get("style", "")] + [n.attrs.get("style", "") for n in self.walk()]
        return " ".join(filter(None, own)).lower()


class _Builder(HTMLParser):
    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)
        self.dropped, self.skipping = dropped, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            self.skipping += 1
        if self.skipping:
            return
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        elif tag in _BLOCKS:
            self._close({"p"}, _BLOCKS - {"p"} | {"td", "th", "li"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here, self.getpos()[0])
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.dropped:
            self.skipping -= 1
        elif not self.skipping and tag not in VOID:
            self.here = self.here.parent or self.root

    def handle_endtag(self, tag):
        if tag in self.dropped:
            self.skipping = max(0, self.skipping - 1)
        elif not self.skipping:
            self._close({tag}, {"table"} if tag in ("p", "li", "b", "i", "a", "span", "font") else set())

    def handle_data(self, data):
        if not self.skipping:
            self.here.children.append(data)

    def _close(self, names: set[str], stop: set[str]) -> None:
        """Closes the nearest open element of these names, unless one of `stop` lies between."""
        node = self.here
        while node.parent is not None and node.name not in names:
            if node.name in stop:
                return
            node = node.parent
        if node.parent is not None:
            self.here = node.parent
            if node.name in ("td", "th") and "tr" in names:
                self._close({"tr"}, stop)


def parse(html: str, drop: tuple[str, ...] = ()) -> Node:
    """The tree of a document or of a part of one; unclosed and stray tags are tolerated. Elements named in `drop` are
    left out with all they hold."""
    builder = _Builder(frozenset(drop))
    builder.feed(html)
    builder.close()
    return builder.root
