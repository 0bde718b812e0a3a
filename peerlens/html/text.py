"""Texts of HTML: normalisation, headers and footers, item clean-up."""

from __future__ import annotations

import re
import unicodedata

from peerlens.html.dom import parse

PAGE_BREAK = "PAGE_BREAK_MARKER"
_HARD_RULE = re.compile(r"<hr[^>]*page-break-after\s*:\s*always[^>]*>", re.IGNORECASE)
# Ornaments that become spaces, and punctuation that becomes ASCII.
_ORNAMENTS = dict.fromkeys(map(ord, "•●■▪◦⁃∙"), " ")
_ASCII = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"})
# Quotes that become ASCII in tables of contents, where ornaments and dashes stay.
_TOC_QUOTES = str.maketrans(dict.fromkeys("‘’‚‛′ʼ´", "'") | dict.fromkeys("“”„″", '"'))
# What headers and footers of pages consist of.
_EDGE_PHRASES = frozenset(("table of contents", "page", "form", "10-k", "10-q", "10-a", "form 10-k summary", "not applicable"))
_EDGE_SHAPES = re.compile(r"\d{1,3}$|[a-z\s]+(?:inc|corp|ltd|llc|co)\.?$|[a-z]+ (?:inc|corp|ltd)\s*\|\s*\d{4}|(?:inc|form|10-?k)\s*\|")
_PAGE_LINE = re.compile(r"page\s+\d{1,4}(?:\s+of\s+\d{1,4})?")
_LEAST_WORDS = 10


def _visible(text: str) -> str:
    """Compatibility forms without invisible characters."""
    text = unicodedata.normalize("NFKC", text)
    return text if text.isascii() else "".join(c for c in text if unicodedata.category(c) != "Cf")


def normalize(text: str) -> str:
    """Compatibility forms, no invisible characters, ornaments as spaces, plain quotes and dashes."""
    return _visible(text).translate(_ORNAMENTS).translate(_ASCII)


def clean_toc(text: str) -> str:
    """The text of a table of contents: compatibility forms, no invisible characters, plain quotes of all kinds, white
    space collapsed."""
    return " ".join(_visible(text).translate(_TOC_QUOTES).split()) if text else ""


def clean(text: str) -> str:
    """normalize, with white space collapsed."""
    return " ".join(normalize(text).split()) if text else ""


def drop_line_artifacts(text: str) -> str:
    """Stripped lines without empty ones, page lines and headings of the table of contents."""
    lines = (line.strip() for line in text.splitlines())
    kept = [s for s in lines if s and s.lower() != "table of contents" and not _PAGE_LINE.fullmatch(s.lower())]
    return re.sub(r"\btable of contents\b", " ", "\n".join(kept), flags=re.IGNORECASE)


def _edge(words: list[str]) -> int:
    """How many words at the front of the list are part of a header (given backwards: of a footer)."""
    one, two = words[0].lower(), " ".join(words[:2]).lower()
    if one.isdigit() or one == "|" or one in _EDGE_PHRASES:
        return 1
    return 1 if _EDGE_SHAPES.match(one) and two not in _EDGE_PHRASES else 2 * (two in _EDGE_PHRASES)


def strip_headers_footers(text: str) -> str:
    """Pages joined by a space, each without header and footer words, as long as more than ten words are left."""
    pages = [p.split() for p in text.split(PAGE_BREAK) if p.strip()]
    out = []
    for words in pages:
        lo, hi = 0, len(words)
        while hi - lo > _LEAST_WORDS:
            last, pair = words[hi - 1].lower(), " ".join(words[hi - 2 : hi]).lower()
            if last.isdigit() or last == "|" or last in _EDGE_PHRASES:
                hi -= 1
            elif pair in _EDGE_PHRASES:
                hi -= 2
            elif _EDGE_SHAPES.match(last):
                hi -= 1
            else:
                break
        while hi - lo > _LEAST_WORDS and (n := _edge(words[lo : lo + 2])):
            lo += n
        out.append(" ".join(words[lo:hi]))
    return " ".join(filter(None, out)) if pages else text


def tidy_item(text: str, item: str, boundary: bool = True) -> str:
    """An item's text from its own heading on; only "Not applicable." or "None." if that is the first sentence after
    the heading; without page numbers at its ends. With `boundary`, item 1 isn't found in "Item 1A" or "Item 10"."""
    text = re.sub(r"\A\s*\d{1,3}\s+(?=ITEM\s+\d+[A-Z]?\b)", "", text.strip(), flags=re.IGNORECASE)
    heading = re.compile(rf"ITEM\s+{re.escape(item)}{'(?![0-9A-Za-z])' if boundary else ''}\s*[.:]?\s*", re.IGNORECASE)
    if found := heading.search(text):
        text = text[found.start() :]
        body = heading.match(text).end()
        early = text[body : body + 420]
        end = re.search(r"\b(?:Not\s+applicable|None)\b\.", early, re.IGNORECASE)
        if end and not re.search(r"[.!?;:]", early[: end.start()]):
            text = text[: body + end.end()]
    return re.sub(r"\s+\d{1,3}\s*\Z", "", text.strip()).strip()


def item_text(html: str, item: str | None = None, boundary: bool = True) -> str:
    """The text of a piece of HTML: marked page breaks, no script or style, cleaned lines, no headers and footers; with
    `item`, also tidied as the text of that item."""
    marked = _HARD_RULE.sub(f"\n{PAGE_BREAK}\n", html)
    text = " ".join(drop_line_artifacts(normalize(parse(marked, ("script", "style")).text("\n"))).split())
    text = strip_headers_footers(text)
    return text if item is None else tidy_item(text, item, boundary)


def plain_text(html: str, drop: tuple[str, ...] = ()) -> str:
    """All strings of a piece of HTML, joined by spaces and collapsed."""
    return " ".join(parse(html, drop).text(" ").split())


def without_scripts(html: str) -> str:
    """The HTML as it is, without script and style elements."""
    return re.sub(r"<(script|style)\b[^>]*>.*?</\1\s*>", "", html, flags=re.IGNORECASE | re.DOTALL)
