"""The heading structure of an item's HTML, as flat nodes in document order.

Blocks are classified one after the other by their text and style; a stack of open headings gives each node its
parent. Flat nodes keep order and parent, so that a nested form can be rebuilt (nested) or written as JSON.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from peerlens.html.dom import Node, parse
from peerlens.html.text import PAGE_BREAK, clean

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BLOCKS = (*_HEADINGS, "p", "li", "div", "table")
# Styles, noise lines and names by which blocks are told apart.
_BOLD = re.compile(r"font-weight\s*:\s*(bold|[6-9]00)")
_SLANTED = re.compile(r"font-style\s*:\s*italic|text-decoration\s*:\s*underline")
_CENTER = re.compile(r"text-align\s*:\s*center")
_ITEM = re.compile(r"\s*items?\s+\d+[a-z]?\b", re.IGNORECASE)
_NOISE = re.compile(r"table of contents\Z|index to exhibits\Z|index to financial statements\Z|part\s+[ivxlcdm]+\Z|table\s+\d+(?:\.\d+)*[:.]?\b|\d{1,4}\Z|page\s+\d{1,4}(?:\s+of\s+\d{1,4})?\Z", re.IGNORECASE)
_FOOTER = re.compile(r"\|\s*\d{4}\s*Form\s*10-[KQ]\s*\|")
_TITLE_LIKE = re.compile(r"[A-Z][A-Za-z0-9,&/\-'(). ]+\Z")
_NAME = r"[A-Z][A-Za-z'\-]+"
_BIOGRAPHY = re.compile(rf"(?:Mr|Ms|Mrs|Dr)\.\s+{_NAME}(?:\s+{_NAME}){{0,3}}\s+is\b|{_NAME}(?:\s+{_NAME}){{1,4}}(?:\s*,\s*\d{{1,3}}\s*,?\s+has\b|\s+is\b)")
# Lengths of headings: least, most, most for a bold sentence, most of a bold lead.
_LEAST, _MOST, _MOST_SENTENCE, _MOST_LEAD = 3, 220, 520, 120
# Few words, mostly capitals, a long sentence, a title's most characters and least words, a short heading.
_FEW_WORDS, _MOSTLY, _LONG, _MOST_TITLE, _TITLE_WORDS, _SHORT = 18, 0.6, 140, 260, 4, 90
# Lengths of a biography's first sentence, and where it has no colon.
_BIOGRAPHY_LENGTHS, _NO_COLON = (40, 520), 80
# Weights of a heading's features, and the weight that is enough without bold.
_WEIGHTS = {"bold": 2, "slanted": 1, "centered": 1, "few words": 1, "capitals": 1, "title-like": 1, "long sentence": -2}
_ENOUGH = 3
# Layers by features, the first that fits.
_LAYERS = (
    (3, ("no bold",)),
    (3, ("sentence in a layer",)),
    (2, ("capitalised",)),
    (2, ("centered",)),
    (2, ("capitals",)),
    (2, ("short",)),
    (3, ()),
)


@dataclass
class Item:
    """A node: kind is heading or simple_text; parent is the index of its parent in the list, -1 for none."""

    kind: str
    layer: int
    heading: str | None
    body: str | None
    parent: int = -1
    path: list[int] = field(default_factory=list)


def _bold(n: Node) -> bool:
    return n.name in ("b", "strong") or bool(_BOLD.search(n.attrs.get("style", "").lower()))


def blocks(root: Node):
    """Blocks of text in order: no division that only wraps smaller blocks, a table as one, nothing inside a table."""
    for n in root.find_all(*_BLOCKS):
        if n.name == "div" and n.find("p", "li", "td", *_HEADINGS):
            continue
        if n.name == "table" or not n.above("table"):
            yield n


def _noise(text: str) -> bool:
    return PAGE_BREAK in text or bool(_FOOTER.search(text) or _NOISE.match(text))


def bold_lead(block: Node, text: str) -> tuple[str, str] | None:
    """Heading and body of a block that begins with a short bold phrase set off by a full stop or colon."""
    first = next((n for n in block.walk() if _bold(n)), None)
    lead = clean(first.text()) if first else ""
    if not lead or len(lead) > _MOST_LEAD or not text.lower().startswith(lead.lower()):
        return None
    rest = text[len(lead) :].strip()
    if not (lead.endswith(".") or rest.startswith((".", ":"))):
        return None
    rest = rest.lstrip(".:").strip()
    return (lead.rstrip(".:").strip(), rest) if rest else None


def heading_layer(block: Node, text: str) -> int | None:
    """The layer of a block that is a heading (1 an item, 2 a title, 3 deeper), None for body text: a block with enough
    weight in its features is a heading, and the first rule of _LAYERS that holds gives its layer."""
    if len(text) < _LEAST or block.name == "table":
        return None
    if _ITEM.match(text):
        return 1
    has = _features(block, text)
    if has["bold"] and (has["biography"] or has["bullet"]) or len(text) > _MOST and not has["bold sentence"]:
        return None
    if not has["bold"] and sum(weight for name, weight in _WEIGHTS.items() if has[name]) < _ENOUGH:
        return None
    return next(layer for layer, names in _LAYERS if all(has[n.removeprefix("no ")] != n.startswith("no ") for n in names))


def _features(block: Node, text: str) -> dict[str, bool]:
    """What is known of a block that may be a heading, by name."""
    style, length, sentence = block.styles(), len(text), text.endswith(".")
    marked = lambda shape, *tags: bool(shape.search(style)) or block.find(*tags) is not None
    letters = [c for c in text if c.isascii() and c.isalpha()]
    words = re.findall(r"[A-Za-z][A-Za-z'\-]*", text)
    bold, strong = marked(_BOLD, "b", "strong"), [n for n in block.walk() if _bold(n)]
    share = lambda yes, of: sum(yes) / of if of else 0.0
    return {
        "bold": bold,
        "slanted": marked(_SLANTED, "i", "em"),
        "centered": bool(_CENTER.search(style)) or block.attrs.get("align", "").lower() == "center",
        "few words": len(text.split()) <= _FEW_WORDS,
        "capitals": share((c.isupper() for c in letters), len(letters)) >= _MOSTLY,
        "title-like": bool(_TITLE_LIKE.match(text)) and not sentence,
        "long sentence": length > _LONG and sentence and not bold,
        "bold sentence": bold and sentence and length <= _MOST_SENTENCE,
        "sentence in a layer": sentence and length <= _MOST_TITLE,
        "capitalised": not sentence and length <= _MOST_TITLE and len(words) >= _TITLE_WORDS and share((w[0].isupper() for w in words), len(words)) >= _MOSTLY,
        "short": length <= _SHORT,
        "biography": _BIOGRAPHY_LENGTHS[0] <= length <= _BIOGRAPHY_LENGTHS[1] and ":" not in text[:_NO_COLON] and bool(_BIOGRAPHY.match(text)),
        "bullet": bool(strong) and all(clean(n.text()) in ("", "•") for n in strong),
    }


def elements(root: Node) -> list[tuple[int | None, str]]:
    """(layer, text) of headings, (None, text) of body blocks."""
    out: list[tuple[int | None, str]] = []
    for block in blocks(root):
        text = clean(block.text())
        if not text or _noise(text):
            continue
        if lead := bold_lead(block, text):
            layer = heading_layer(block, lead[0])
            out += [(2 if layer is None else layer, lead[0]), (None, lead[1])]
        else:
            out.append((heading_layer(block, text), text))
    return out


def _tree(parts: list[tuple[int | None, str]]) -> list[Item]:
    nodes: list[Item] = []
    open_: list[int] = []
    for layer, text in parts:
        if layer is not None:
            while open_ and nodes[open_[-1]].layer >= layer:
                open_.pop()
            nodes.append(Item("heading", layer, text, None, open_[-1] if open_ else -1))
            open_.append(len(nodes) - 1)
            continue
        if not open_ and not (nodes and nodes[-1].kind == "simple_text"):
            nodes.append(Item("simple_text", 1, None, text))
            continue
        at = nodes[open_[-1] if open_ else -1]
        at.body = f"{at.body} {text}" if at.body else text
    return nodes


def _bare(text: str) -> str:
    return " ".join(re.sub(r"[^A-Za-z0-9]+", " ", re.sub(r"['’]", "", text)).lower().split())


def without_title(text: str, title: str) -> str:
    """The text without the title (or the title without its item number) at its start, compared by letters and digits."""
    for candidate in (title, re.sub(r"\A\s*item\s+\d+[a-z]?\s*\.?\s*", "", title, flags=re.IGNORECASE)):
        wanted = _bare(candidate)
        if wanted and _bare(text).startswith(wanted):
            left = len(wanted.replace(" ", ""))
            for i, c in enumerate(text):
                left -= c.isascii() and c.isalnum()
                if not left:
                    return text[i + 1 :].lstrip(" .:-|,;/").strip()
    return text


def _under_title(nodes: list[Item], title: str) -> list[Item]:
    """All nodes under one heading, the item's title: headings of the item itself and text before any heading become
    its body, repeated empty headings are dropped, and layers below start at 2."""
    token = m[1] if (m := re.search(r"items?\s+(\d+[a-z]?)", title, re.IGNORECASE)) else r"\d+[a-z]?"
    own = re.compile(rf"\s*items?\s+{token}\b", re.IGNORECASE)
    children: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        children.setdefault(n.parent, []).append(i)
    body, tops = [], []
    for i in children.get(-1, []):
        if nodes[i].kind == "heading" and own.match(nodes[i].heading or ""):
            body += [nodes[i].body] if nodes[i].body else []
            tops += children.get(i, [])
        else:
            tops.append(i)
    seen: set = set()
    root = Item("heading", 1, title, None)
    out, loose = [root], []
    for i in tops:
        n = nodes[i]
        key = (n.kind, n.layer, (n.heading or "").lower())
        if n.kind == "simple_text":
            loose.append(n.body or "")
        elif not (key in seen and not n.body and i not in children):
            todo = [(i, 0, 2)]
            while todo:
                at, parent, least = todo.pop()
                m_ = nodes[at]
                out.append(Item(m_.kind, max(m_.layer, least), m_.heading, m_.body, parent))
                here = len(out) - 1
                todo += [(c, here, least + 1) for c in reversed(children.get(at, []))]
        seen.add(key)
    joined = " ".join(filter(None, (without_title(t, title) for t in (*body, *loose))))
    root.body = without_title(joined, title) or None
    return out


def structure(html: str, title: str | None = None) -> list[Item]:
    """The nodes of an item's HTML, with path (positions among siblings from the top). A piece of HTML without any
    block is one simple_text node; an empty one has none."""
    root = parse(html, ("script", "style"))
    nodes = _tree(elements(root))
    if not nodes and (text := clean(root.text())):
        nodes = [Item("simple_text", 1, None, text)]
    if title and (title := clean(title)):
        nodes = _under_title(nodes, title)
    count: dict[int, int] = {}
    for n in nodes:
        place = count.get(n.parent, 0)
        count[n.parent] = place + 1
        n.path = [*(nodes[n.parent].path if n.parent >= 0 else []), place]
    return nodes


def nested(nodes: list[Item]) -> list[dict]:
    """The nodes as a tree of dictionaries with children."""
    made = [{"type": n.kind, "layer": n.layer, "heading": n.heading, "body": n.body, "children": []} for n in nodes]
    for n, d in zip(nodes, made):
        if n.parent >= 0:
            made[n.parent]["children"].append(d)
    return [d for n, d in zip(nodes, made) if n.parent < 0]


def flat(tree: list[dict], parent: int = -1, out: list[Item] | None = None, path: tuple[int, ...] = ()) -> list[Item]:
    """The flat nodes of a nested tree, the inverse of nested."""
    out = [] if out is None else out
    for i, d in enumerate(tree):
        out.append(Item(d.get("type", "heading"), int(d.get("layer") or 1), d.get("heading"), d.get("body"), parent, [*path, i]))
        flat(d.get("children") or [], len(out) - 1, out, (*path, i))
    return out


def field_texts(tree, name: str) -> list[str]:
    """All non-empty values of a field in any nest of lists and dictionaries, in document order."""
    out: list[str] = []
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get(name), str) and x[name].strip():
                out.append(x[name].strip())
            stack += reversed([v for v in x.values() if isinstance(v, (dict, list))])
        elif isinstance(x, list):
            stack += reversed(x)
    return out
