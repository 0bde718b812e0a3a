"""Filings to items and items to nodes, over Arrow batches: narrow, no shuffle, one parse of the table of contents and
one search for spans for each filing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.config import FORM_ITEMS
from peerlens.html import structure as S
from peerlens.html import text as H
from peerlens.html.spans import inversions, item_spans
from peerlens.html.toc import parse_toc

#: Filings reach megabytes: few rows are worked on at once.
_ROWS = 64

_ITEM_TYPE = pa.struct([("ord", pa.int32()), ("item_id", pa.string()), ("item_title", pa.string()), ("anchor", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("html_content", pa.string()), ("text_content", pa.string()), ("error", pa.string()), ("out_of_order", pa.bool_())])
_ITEM_DDL = "ARRAY<STRUCT<ord INT, item_id STRING, item_title STRING, anchor STRING, start_pos BIGINT, end_pos BIGINT, html_content STRING, text_content STRING, error STRING, out_of_order BOOLEAN>>"
_NODE_TYPE = pa.struct([("node_ord", pa.int32()), ("parent_ord", pa.int32()), ("path", pa.list_(pa.int32())), ("type", pa.string()), ("layer", pa.int32()), ("heading", pa.string()), ("body", pa.string())])
_NODE_DDL = "ARRAY<STRUCT<node_ord INT, parent_ord INT, path ARRAY<INT>, type STRING, layer INT, heading STRING, body STRING>>"


def filing_items(html: str, form: str | None = None, boundary: bool = True) -> list[dict]:
    """The items of one filing, in the order of its table of contents: text, or the error that kept it from being read.
    Without table of contents, or without an item in the form's scope, none."""
    toc = parse_toc(html) or []
    scope = FORM_ITEMS.get(form or "")
    spans = item_spans(html, toc)
    odd = set(inversions(toc, spans))
    out = []
    for i, e in enumerate(toc):
        if scope is not None and e.item not in scope:
            continue
        row = {"ord": i, "item_id": e.item, "item_title": e.title, "anchor": e.anchor, "out_of_order": e.item in odd}
        if e.item not in spans:
            row["error"] = f"item {e.item} could not be located"
        else:
            a, b = row["start_pos"], row["end_pos"] = spans[e.item]
            try:
                row |= {"html_content": html[a:b], "text_content": H.item_text(html[a:b], e.item, boundary)}
            except Exception as error:  # noqa: BLE001 - one item must not stop the others
                row["error"] = str(error)
        out.append(row)
    return out


def _added(df: DataFrame, inputs: list, name: str, kind: pa.DataType, ddl: str, f, without: tuple[str, ...] = ()) -> DataFrame:
    """df without some columns, with one made by f from the input columns of each row. Long texts that only f needs
    should be among those left out: they are then sent to Python but not back."""
    args = [f"_a{i}" for i in range(len(inputs))]
    kept = [x for x in df.schema.fields if x.name not in without]
    rows = df.select(*(x.name for x in kept), *(c.alias(a) for c, a in zip(inputs, args)))
    fields = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                made = [f(*values) for values in zip(*(part.column(a).to_pylist() for a in args))]
                yield part.drop_columns(args).append_column(name, pa.array(made, kind))

    return rows.mapInArrow(run, f"{fields}{name} {ddl}")


def in_scope(form: Column, item: Column) -> Column:
    """True for items that a form asks for; forms without a list ask for all."""
    listed = [(form == name) & item.isin(list(items)) for name, items in FORM_ITEMS.items()]
    return F.coalesce(reduce(or_, listed, ~form.isin(list(FORM_ITEMS))), F.lit(False))


def extract_items(filings: DataFrame, html: str = "html", form: str = "form", boundary: bool = True) -> DataFrame:
    """A row for each item of each filing: the filing's columns but html, and ord, item_id, item_title, anchor,
    start_pos, end_pos, html_content, text_content, error, out_of_order. Filings without HTML have no items."""
    made = _added(filings, [F.col(html), F.col(form)], "_items", pa.list_(_ITEM_TYPE), _ITEM_DDL, lambda h, f: filing_items(h, f, boundary) if h else [], (html,))
    return made.select(*made.columns[:-1], F.inline("_items"))


def toc_entries(filings: DataFrame, html: str = "html") -> DataFrame:
    """A row for each entry of each table of contents: the filing's columns but html, and ord, item_id, anchor, title."""
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("item_id", pa.string()), ("anchor", pa.string()), ("title", pa.string())]))
    entries = lambda h: [{"ord": i, "item_id": e.item, "anchor": e.anchor, "title": e.title} for i, e in enumerate(parse_toc(h) or [])] if h else []
    made = _added(filings, [F.col(html)], "_toc", kind, "ARRAY<STRUCT<ord INT, item_id STRING, anchor STRING, title STRING>>", entries, (html,))
    return made.select(*made.columns[:-1], F.inline("_toc"))


def structure_nodes(items: DataFrame, html: str = "html_content", title: str | None = "item_title") -> DataFrame:
    """A row for each node of each item: the item's columns but html, and node_ord, parent_ord, path, type, layer,
    heading, body."""

    def nodes(h: str | None, t: str | None) -> list[dict]:
        return [{"node_ord": i, "parent_ord": n.parent, "path": n.path, "type": n.kind, "layer": n.layer, "heading": n.heading, "body": n.body} for i, n in enumerate(S.structure(h, t))] if h else []

    named = F.col(title) if title else F.lit(None).cast("string")
    made = _added(items, [F.col(html), named], "_nodes", pa.list_(_NODE_TYPE), _NODE_DDL, nodes, (html,))
    return made.select(*made.columns[:-1], F.inline("_nodes"))


def field_text(nodes: DataFrame, keys: list[str], name: str = "heading") -> DataFrame:
    """keys, text: the non-empty headings (or bodies) of each item in order, with empty lines between."""
    value = F.btrim(F.col(name))
    rows = nodes.where(F.coalesce(value, F.lit("")) != "").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node_ord", value.alias("v")))).alias("_l"))
    return rows.select(*keys, F.array_join(F.transform("_l", lambda x: x["v"]), "\n\n").alias("text"))


def html_texts(df: DataFrame, html: str, how: str = "plain") -> DataFrame:
    """Adds text: `plain` (all strings), `visible` (without script and style) or `item` (cleaned as an item's text).
    Null stays null."""
    f = {"plain": H.plain_text, "visible": lambda h: H.plain_text(h, ("script", "style")), "item": H.item_text}[how]
    return _added(df, [F.col(html)], "text", pa.string(), "STRING", lambda h: None if h is None else f(h))


def normalized(df: DataFrame, text: str) -> DataFrame:
    """Adds normalized: compatibility forms, no invisible characters, plain quotes and dashes."""
    return _added(df, [F.col(text)], "normalized", pa.string(), "STRING", lambda t: None if t is None else H.normalize(t))


def tidied(df: DataFrame, text: str, item: str) -> DataFrame:
    """Adds tidied: the item's text without preamble, headers, footers and page numbers."""
    tidy = lambda t, i: None if t is None else H.tidy_item(H.strip_headers_footers(" ".join(t.split())), i or "")
    return _added(df, [F.col(text), F.col(item)], "tidied", pa.string(), "STRING", tidy)
