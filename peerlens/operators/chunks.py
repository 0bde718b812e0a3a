"""Items to units: sizes, windows, packing of paragraphs, roll-up."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.config import CHUNK_TOKENS, DEFAULT_CHUNK_TOKENS, MIN_UNIT_TOKENS, MIN_UNITS
from peerlens.functions import text as X
from peerlens.functions.vectors import let


#: A text to its number of tokens.
Counter = Callable[[str], int]


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class FileCounter:
    """Counts the tokens of a tokenizer file (JSON of the tokenizers library, which must be installed), loaded once in each
    worker; the file's path must be the same on all of them."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        return len(_tokenizer(self.path).encode(text, add_special_tokens=False).ids)


def count_words(text: str) -> int:
    return len(text.split())


def chunk_tokens(item: Column, override: int | None = None) -> Column:
    """Words of a chunk for a normalised item id."""
    if override is not None:
        return F.lit(int(override))
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CHUNK_TOKENS.items()))
    return F.coalesce(F.try_element_at(known, item), F.lit(DEFAULT_CHUNK_TOKENS))


def overlap_tokens(item: Column, chunk: Column, override: int | None = None) -> Column:
    """Words that neighbouring chunks share: a fifth of the item's default size, from 40 to 120. The item's default
    counts even if the chunk size is overridden; an item without default takes the chunk size."""
    if override is not None:
        return F.lit(int(override))
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CHUNK_TOKENS.items()))
    fifth = F.bround(F.coalesce(F.try_element_at(known, item), chunk) * F.lit(0.2)).cast("int")
    return F.greatest(F.lit(40), F.least(F.lit(120), fifth))


def word_windows(text: Column, size: Column, step: Column, least: int = 1) -> Column:
    """Windows of `size` words every `step` words, joined by spaces; those of fewer than `least` words are left out."""

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.greatest(step, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, lambda i: F.slice(w, i, size))
        return F.transform(F.filter(windows, lambda x: F.size(x) >= least), lambda x: F.array_join(x, " "))

    return F.when(text.isNotNull(), let(X.words(text), cut))


def pack_paragraphs(text: str, chunk: int, overlap: int, least: int, count: Counter = count_words) -> list[str]:
    """Units of a text: short paragraphs packed up to `chunk` tokens, long ones as overlapping windows of so many words.

    A long paragraph doesn't end the pack that is being filled, so units may come out of document order. Units under
    `least` tokens (windows: words) are dropped.
    """
    units: list[str] = []
    pack: list[str] = []
    filled = 0

    def close() -> None:
        if pack and count(unit := "\n\n".join(pack)) >= least:
            units.append(unit)

    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        size = count(paragraph)
        if size >= chunk:
            own = paragraph.split()
            pieces = (own[i : i + chunk] for i in range(0, len(own), max(1, chunk - overlap)))
            units += [" ".join(p) for p in pieces if len(p) >= least]
        elif filled + size > chunk:
            close()
            pack, filled = [paragraph], size
        else:
            pack.append(paragraph)
            filled += size
    close()
    return units


def units(items: DataFrame, keys: list[str], item: str, text: str, chunk: int | None = None, overlap: int | None = None, least: int = MIN_UNIT_TOKENS, min_units: int = MIN_UNITS, counter: Counter | None = None) -> DataFrame:
    """keys, item, unit_id (from 1), unit_text, unit_tokens, chunk_tokens, overlap_tokens. Items with fewer than
    `min_units` units have none. Tokens are words, unless a counter is given. Narrow: each text is packed where it is read."""
    name = X.item_id(F.col(item))
    sized = items.select(*keys, name.alias("item_id"), X.canonical(F.col(text)).alias("_text"), chunk_tokens(name, chunk).alias("chunk_tokens"))
    sized = sized.withColumn("overlap_tokens", overlap_tokens(F.col("item_id"), F.col("chunk_tokens"), overlap)).where("_text <> ''")
    fields = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in sized.drop("_text").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = (batch.column(c).to_pylist() for c in ("_text", "chunk_tokens", "overlap_tokens"))
            packed = [pack_paragraphs(t, c, o, least, counter or count_words) for t, c, o in zip(*args)]
            packed = [u if len(u) >= min_units else [] for u in packed]
            batch = batch.drop_columns(["_text"]).append_column("units", pa.array(packed, pa.list_(pa.string())))
            yield batch.append_column("counts", pa.array([[counter(x) for x in u] if counter else None for u in packed], pa.list_(pa.int32())))

    packed = sized.select(*keys, "item_id", "chunk_tokens", "overlap_tokens", "_text").mapInArrow(run, fields + "units ARRAY<STRING>, counts ARRAY<INT>")
    out = packed.select(*keys, "item_id", F.posexplode("units").alias("unit_id", "unit_text"), "chunk_tokens", "overlap_tokens", "counts")
    tokens = F.try_element_at("counts", F.col("unit_id") + 1) if counter else X.token_count(F.col("unit_text"))
    return out.withColumn("unit_tokens", tokens).withColumn("unit_id", F.col("unit_id") + 1).drop("counts")


def unit_rollup(unit_rows: DataFrame, keys: list[str], min_units: int = MIN_UNITS) -> DataFrame:
    """keys, num_units, item_tokens of items with at least `min_units` units."""
    return unit_rows.groupBy(*keys).agg(F.count("*").alias("num_units"), F.sum("unit_tokens").alias("item_tokens")).where(F.col("num_units") >= min_units)
