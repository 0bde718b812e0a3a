"""Documents are written inline; each name says which trap it holds."""

from peerlens.html import structure as S
from peerlens.html import text as H
from peerlens.html.dom import parse
from peerlens.html.spans import inversions, item_spans
from peerlens.html.toc import clean_title, item_number, item_numbers, parse_toc
from peerlens.operators.filings import filing_items

BODY = "We make things and sell them in many countries, each year more of them than before. " * 6


def filing(*items, toc=True, marker="TABLE OF CONTENTS", end='<div id="signatures">SIGNATURES</div>'):
    rows = "".join(f'<tr><td><a href="#{a}">Item {n}.</a></td><td>{t}</td><td>{i + 3}</td></tr>' for i, (n, t, a, _) in enumerate(items))
    parts = "".join(f'<div id="{a}"><p><b>Item {n}. {t}</b></p>{b}</div>' for n, t, a, b in items)
    return f"<html><body><p>{marker}</p>{'<table>' + rows + '</table>' if toc else ''}{parts}{end}</body></html>"


THREE = [("1", "Business", "i1", f"<p>{BODY}</p>"), ("1A", "Risk Factors", "i1a", "<p>Much may go wrong.</p>"), ("7", "Discussion", "i7", "<p>We earned money.</p>")]


def test_tree_tolerates_unclosed_tags():
    root = parse("<p><b>one<p>two<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table>", ())
    assert [n.name for n in root.find_all("p")] == ["p", "p"]
    assert [n.text() for n in root.find_all("li")] == ["a", "b"]
    assert [[c.text() for c in r.find_all("td")] for r in root.find_all("tr")] == [["x", "y"], ["z"]]
    assert parse("a<script>b<p>c</script>d", ("script",)).text() == "ad"


def test_toc_table_spans_and_end_marker():
    html = filing(*THREE)
    toc = parse_toc(html)
    assert [(e.item, e.anchor) for e in toc] == [("1", "i1"), ("1A", "i1a"), ("7", "i7")]
    spans = item_spans(html, toc)
    assert html[slice(*spans["1A"])].startswith('<div id="i1a">') and "Item 7" not in html[slice(*spans["1A"])]
    assert html[spans["7"][1] :].startswith('<div id="signatures">')
    assert not inversions(toc, spans)


def test_links_without_table_need_five():
    def links(n):
        head = "".join(f'<p><a href="#x{i}">Item {i}. Part {i}</a></p>' for i in range(1, n + 1))
        return head + "".join(f'<div id="x{i}">Item {i}. text</div>' for i in range(1, n + 1))

    assert [e.item for e in parse_toc(links(5))] == list("12345")
    assert parse_toc(links(4)) is None
    assert parse_toc("<p>nothing here</p>") is None


def test_combined_items_share_their_section():
    html = '<p>Table of Contents</p><table><tr><td><a href="#a">Items 1 and 2. Business and Properties</a></td></tr><tr><td><a href="#b">Item 3. Legal</a></td></tr><tr><td><a href="#c">Item 4. Mines</a></td></tr></table>' f'<div id="a">Items 1 and 2. {BODY}</div><div id="b">Item 3. None.</div>'
    spans = item_spans(html, parse_toc(html))
    assert spans["1"] == spans["2"] and html[spans["1"][1] :].startswith('<div id="b">')


def test_item_without_anchor_takes_the_last_heading_between_its_neighbours():
    html = f'<p>Table of Contents</p><table><tr><td><a href="#a">Item 1. Business</a></td></tr><tr><td>Item 2. Properties</td></tr><tr><td><a href="#c">Item 3. Legal</a></td></tr></table><div id="a">Item 1. see Item 2 below. {BODY}</div><p>Item 2. Properties</p><p>land</p><div id="c">Item 3. x</div>'
    spans = item_spans(html, parse_toc(html))
    assert html[slice(*spans["2"])] == "<p>Item 2. Properties</p><p>land</p>"
    assert html[spans["1"][1] :].startswith("<p>Item 2. Properties")


def test_missing_anchor_is_an_error_and_does_not_stop_the_others():
    html = filing(*THREE).replace('id="i1a"', 'id="gone"')
    rows = {r["item_id"]: r for r in filing_items(html)}
    assert "error" in rows["1A"] and "text_content" in rows["7"] and rows["1"]["text_content"].startswith("Item 1. Business")


def test_part_heading_is_cut_off_only_within_the_guards():
    late = filing(("1", "Business", "a", f"<p>{BODY}</p><p>PART II</p>"), ("5", "Market", "b", "<p>x</p>"), ("6", "Data", "c", "<p>y</p>"))
    early = filing(("1", "Business", "a", f"<p>PART II</p><p>{BODY}</p>"), ("5", "Market", "b", "<p>x</p>"), ("6", "Data", "c", "<p>y</p>"))
    cut = lambda h: h[slice(*item_spans(h, parse_toc(h))["1"])]
    assert "PART II" not in cut(late) and "PART II" in cut(early)


def test_scope_of_the_form():
    html = filing(*THREE, ("9", "Changes", "i9", ""))
    assert [r["item_id"] for r in filing_items(html, "10-Q")] == ["1"]
    assert len(filing_items(html, "20-F")) == 4


def test_out_of_order_items_are_flagged():
    html = filing(*THREE)
    toc = parse_toc(html)
    toc = [toc[1], toc[2], toc[0]]
    assert inversions(toc, item_spans(html, toc)) == ["1"]


def test_item_numbers():
    assert item_numbers("Items 1 and 2. Business and Properties") == ["1", "2"]
    assert item_numbers("PART II. 5. Market for") == ["5"]
    assert item_numbers("1A. Risk Factors") == ["1A"]
    assert item_number("1Business") == "1" and item_number("1Business", compat=True) == "1B"
    assert item_number("9Changes in") == "9" and item_number("2Properties") == "2"
    assert item_number("no number") is None
    assert clean_title("Item 1. Business 12") == "Item 1. Business" and clean_title("Business.7") == "Business."


def test_page_breaks_headers_and_footers():
    page = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    html = f"<p>{page}</p><p>12</p><hr style='page-break-after:always'><p>Table of Contents</p><p>{page}</p><p>Page 13</p>"
    assert H.item_text(html) == f"{page} {page}"
    assert H.strip_headers_footers("one two 3") == "one two 3"


def test_normalisation():
    assert H.normalize("“a”–b​ ﬁ ’s•") == '"a"-b fi \'s '
    assert H.drop_line_artifacts("a\n\n Page 3 of 9 \nTable of Contents\nb table of contents c") == "a\nb   c"


def test_not_applicable_ends_the_item_only_as_first_sentence():
    assert H.tidy_item("12 Item 4. Mine Safety Disclosures Not applicable. PART II more", "4") == "Item 4. Mine Safety Disclosures Not applicable."
    text = "Item 4. Mines. We have some. Not applicable. More 7"
    assert H.tidy_item(text, "4") == text[:-2]
    assert H.tidy_item("See Item 1A first. Item 1. Business is good", "1") == "Item 1. Business is good"
    assert H.tidy_item("See Item 1A first. Item 1. Business is good", "1", boundary=False).startswith("Item 1A first")


def test_plain_text_keeps_or_drops_scripts():
    assert H.plain_text("<p>a</p><style>b</style>") == "a b"
    assert H.plain_text("<p>a</p><style>b</style>", ("style",)) == "a"
    assert H.without_scripts("<p>a</p><script>x<y</script>b") == "<p>a</p>b"


RISKS = """<p><b>Item 1A. Risk Factors</b></p><p>Before any risk.</p><p style="text-align:center"><b>RISKS OF OUR BUSINESS</b></p>
<p><b>We may lose customers.</b></p><p>They may leave.</p><p>And not return.</p><p><b>Talent.</b> We need people.</p>
<ul><li><b>•</b> a bullet that is not bold but quite long and ends with a full stop.</li></ul>
<table><tr><td>1</td><td>2</td></tr></table><p><b>Mr. John Smith is</b> our chief officer since the year of 1999 and lives nearby.</p><p>12</p><p>Part II</p>"""


def test_structure_layers_bodies_and_noise():
    nodes = S.structure(RISKS, "Item 1A. Risk Factors")
    seen = [(n.kind, n.layer, n.heading, n.parent) for n in nodes]
    assert seen[0] == ("heading", 1, "Item 1A. Risk Factors", -1)
    assert nodes[0].body == "Before any risk."
    assert seen[1] == ("heading", 2, "RISKS OF OUR BUSINESS", 0)
    assert seen[2] == ("heading", 3, "We may lose customers.", 1) and nodes[2].body == "They may leave. And not return."
    talent = next(n for n in nodes if n.heading == "Talent")
    assert talent.layer == 2 and talent.body.startswith("We need people.") and "a bullet" in talent.body and "Mr. John Smith is" in talent.body
    assert not any(n.heading in ("12", "Part II") for n in nodes)
    assert [n.path for n in nodes[:3]] == [[0], [0, 0], [0, 0, 0]]


def test_nested_and_flat_are_inverse():
    nodes = S.structure(RISKS)
    again = S.flat(S.nested(nodes))
    assert [(n.kind, n.layer, n.heading, n.body, n.parent, n.path) for n in again] == [(n.kind, n.layer, n.heading, n.body, n.parent, n.path) for n in nodes]
    assert S.field_texts(S.nested(nodes), "heading")[0] == "Item 1A. Risk Factors"


def test_structure_without_blocks():
    assert [(n.kind, n.body) for n in S.structure("just text")] == [("simple_text", "just text")]
    assert S.structure("") == []
    assert S.without_title("Risk Factors: we may fail", "Item 1A. Risk Factors") == "we may fail"
