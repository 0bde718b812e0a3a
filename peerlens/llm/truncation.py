"""Problem 8: texts that were cut off, by a backward character n-gram model.

The model reads backwards from a position: its contexts are the last 2, 3, 4, ... characters before it. For each
context it counts, over all texts, how often a break follows (the end of a text, of a line or of a sentence) and how
often the text goes on. The final context of a text then has a probability of a break, interpolated from short to
long contexts; the text's own end is left out of its counts. Its log-odds against going on are low where the text
stops where other texts go on. The threshold lies at the valley of these log-odds within each language and column.

Only contexts that end some text are counted; a bitmap of fixed size sorts the others out where the texts are read.
Ends of repeated texts count once, so that a cut text that was posted again doesn't vouch for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.llm.kernels import U64, char_values, code_points, mix, prefix_hash, ranges, span_hash
from peerlens.plans import stage

ORDERS = (2, 3, 4, 6, 8, 10)
#: Weight of the shorter context, and probability of a break without any context.
PRIOR_WEIGHT, PRIOR = 3.0, 0.02
#: Bits of the bitmap of final contexts: 16 for each, up to 2**30 (128 MB), which 11 million texts fill so far. With more
#: texts it lets more contexts through that end no text; the result stays the same.
LEAST_BITS, MOST_BITS = 20, 30
#: Contexts of the first SHORT orders end very many texts: each is kept SALTS times, so that no task gets all that ask.
SHORT, SALTS = 2, 16
#: Where valleys are looked for, in quarters of log-odds, and the one that is taken of equals.
LOWEST, HIGHEST, MIDDLE = -12, 0, -6
#: Texts of all languages that are mixed into the histogram of each.
SHARED = 200

# What feeds put after a cut, and what is left of markup that was itself cut.
_APPENDED = re.compile(r"(?:\s|…|\.\.\.|&hellip;|[\[(](?:more|cont|cont\.|continued|truncated|cut|snip|\.\.\.|…)[\])]?|&[a-z#0-9]{0,7}|<[a-z/]{0,7}|</?br ?/?>|read more)+\Z", re.IGNORECASE)
# Characters after which a sentence may end.
_TERMINATORS = ".!?\"')”’…]|:"
_FULL_WIDTH = "。！？"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower case, if that is one character; digits become 0, sentence ends a full stop."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    out[ord("0") : ord("9") + 1] = ord("0")
    out[[ord("!"), ord("?")]] = ord(".")
    return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bits for each code point: 1 white space, 2 line end, 4 terminator, 8 full-width terminator, 16 lower case."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x3001):
        out[c] = chr(c).isspace() + 16 * chr(c).islower()
    out[[10, 13]] |= 2
    out[[ord(c) for c in _TERMINATORS]] |= 4
    out[[ord(c) for c in _FULL_WIDTH]] |= 8
    return out


def bare(text: str) -> str:
    """The text without what was put after its end; the text without trailing white space if nothing else is left."""
    start = len(text)
    # the pattern is anchored at the end: look for its start in growing tails instead of at each place of the text
    tail = 64
    while True:
        m = _APPENDED.search(text, max(0, len(text) - tail))
        if m is None or m.start() > len(text) - tail or tail >= len(text):
            start = m.start() if m else len(text)
            break
        tail *= 4
    return text[:start] or text.rstrip()


def context_keys(prefix: np.ndarray, end: np.ndarray, order: int) -> np.ndarray:
    """Keys of the contexts of `order` characters before each position; the lowest bit is free."""
    return mix(span_hash(prefix, end - order, end) ^ U64(order * 0x9E3779B97F4A7C15 % (1 << 64))) & ~U64(1)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The final contexts of each text, from short to long; of a short text fewer."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        tails = [bare(t)[-max(ORDERS) :] for t in texts]
        codes, starts = code_points(tails)
        prefix = prefix_hash(char_values()[_folded()[codes]])
        ends, n = starts[1:] - 1, np.diff(starts) - 1
        keys = np.stack([context_keys(prefix, np.where(n >= k, ends, k), k) for k in ORDERS], axis=1) if len(texts) else np.zeros((0, len(ORDERS)), U64)
        there = n[:, None] >= np.asarray(ORDERS)
        offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[there].view(np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "lang", "source", "column", "name")), listed], ["id", "lang", "source", "column", "name", "keys"])


def _tally(sent, bits: int):
    """Counts of the contexts in the bitmap at all places but the ends of texts: place (of the order), key, seen, breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, classes, folded = sent.value, _classes(), _folded()
        for batch in batches:
            texts = [bare(t) for t in batch.column("text").to_pylist()]
            for x, y in ranges(np.fromiter(map(len, texts), np.int64, len(texts)), 1_000_000):
                codes, starts = code_points(texts[x:y])
                kind = classes[codes]
                prefix = prefix_hash(char_values()[folded[codes]])
                within = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
                before, here = kind[:-1], kind[1:]
                after = np.append(kind[2:], 0)
                ends_line, space, small = here & 2 > 0, here & 1 > 0, after & 16 > 0
                broken = ends_line | (before & 8 > 0) | ((before & 4 > 0) & space & ~small)
                at = np.arange(1, len(codes))
                inner = (codes[1:] != 0) & (within[1:] > 0) & (before & 1 == 0)
                for place, k in enumerate(ORDERS):
                    p = at[inner & (within[1:] >= k)]
                    key = context_keys(prefix, p, k)
                    slot = key >> U64(64 - bits)
                    known = (bitmap[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 > 0
                    keys = np.sort(key[known] | broken[p[known] - 1].astype(U64))
                    if not len(keys):
                        continue
                    bare_key = keys & ~U64(1)
                    first = np.flatnonzero(np.concatenate([[True], bare_key[1:] != bare_key[:-1]]))
                    seen = np.diff(np.append(first, len(keys)))
                    breaks = np.add.reduceat((keys & U64(1)).astype(np.int64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), place, np.int32)), pa.array(bare_key[first].view(np.int64)), pa.array(seen), pa.array(breaks)], ["place", "key", "seen", "breaks"])

    return run


def _bitmap(ends: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all final contexts, put together by Spark in words of 64 bits; its size doesn't depend on the
    number of texts."""
    slot = F.shiftrightunsigned("key", 64 - bits)
    words = ends.select(F.explode("keys").alias("key")).select(F.shiftrightunsigned(slot, 6).cast("int").alias("word"), (slot % 64).cast("int").alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    got = words.groupBy("word").agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _odds() -> Column:
    """Log-odds of a break from the counts of all contexts, sorted from short to long; the text's own end is left out."""
    step = lambda p, c: (c["breaks"] - 1 + PRIOR_WEIGHT * p) / (c["seen"] - 1 + PRIOR_WEIGHT)
    p = F.aggregate("counts", F.lit(PRIOR), step)
    return F.log(F.greatest(p, F.lit(1e-12)) / F.greatest(1 - p, F.lit(1e-12)))


def end_scores(df: DataFrame, id_col: str, text_col: str | Sequence[str], lang_col: str | None = None, source_col: str | None = None) -> DataFrame:
    """id, column, lang, source and odds of every text that isn't null or blank: the log-odds that a break follows its
    last characters. lang is lower-cased, `und` if it is null. Rows without id are left out."""
    spark = df.sparkSession
    columns = [text_col] if isinstance(text_col, str) else list(text_col)
    lang = F.coalesce(F.lower(F.trim(df[lang_col].cast("string"))), F.lit("und")) if lang_col else F.lit("und")
    source = df[source_col].cast("string") if source_col else F.lit(None).cast("string")
    texts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), df[c].alias("text")) for c in columns)))
    rows = df.select(df[id_col].alias("id"), lang.alias("lang"), source.alias("source"), texts.alias("t")).select("id", "lang", "source", "t.*")
    rows = rows.where("id IS NOT NULL AND text RLIKE '(?U)\\\\S'")
    kind = rows.schema["id"].dataType.simpleString()
    named = rows.withColumn("name", F.md5("text"))
    ends = stage(named.mapInArrow(_ends, f"id {kind}, lang STRING, source STRING, column STRING, name STRING, keys ARRAY<BIGINT>"), "truncation-ends")
    n = max(1, ends.count())
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(16 * len(ORDERS) * n)))))
    sent = spark.sparkContext.broadcast(_bitmap(ends, bits))
    inner = rows.select("text").mapInArrow(_tally(sent, bits), "place INT, key BIGINT, seen BIGINT, breaks BIGINT")
    one = F.lit(1).cast("bigint")
    final = ends.dropDuplicates(["name"]).select(F.posexplode("keys").alias("place", "key"), one.alias("seen"), one.alias("breaks"))
    model = inner.unionByName(final).groupBy("place", "key").agg(F.sum("seen").alias("seen"), F.sum("breaks").alias("breaks"))
    salts = F.when(F.col("place") < SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    model = model.withColumn("salt", F.explode(salts))
    keys = ["id", "column", "lang", "source", "name"]
    asked = ends.select(*keys, F.posexplode("keys").alias("place", "key"))
    asked = asked.withColumn("salt", F.when(F.col("place") < SHORT, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    counts = asked.join(model, ["place", "key", "salt"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "seen", "breaks"))).alias("counts"))
    return counts.select("id", "column", "lang", "source", _odds().alias("odds"))


def thresholds(scores: DataFrame) -> DataFrame:
    """lang, column, limit: the log-odds below which a text is cut, the middle of the emptiest stretch of the histogram
    in bins of a quarter. To each histogram as much is added of the one of all languages as SHARED texts amount to: it
    hardly moves a language with many texts and leads one with few, without a size at which the rule changes."""
    bin_ = F.when(F.col("odds").between(LOWEST / 4 - 1, HIGHEST / 4 + 1), F.floor(F.col("odds") * 4).cast("int"))
    bins = scores.groupBy("lang", "column", bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = [(r.bin, r.n) for r in bins.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("n").alias("n")).collect()]
    share = SHARED / max(1, scores.count())
    pooled = F.create_map(*(F.lit(v) for b, n in every for v in (b, n * share))) if every else F.create_map().cast("map<int,double>")
    own = bins.groupBy("lang", "column").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.col("n").cast("double"))))).alias("own"))
    of = lambda m, b: F.coalesce(F.try_element_at(m, b), F.lit(0.0))
    near = lambda b: sum((of(F.col("own"), b + i) + of(pooled, b + i) for i in range(-2, 2)), F.lit(0.0))
    places = F.transform(F.sequence(F.lit(LOWEST), F.lit(HIGHEST)), lambda b: F.struct(F.round(near(b), 6).alias("n"), F.abs(b - MIDDLE).alias("far"), b.alias("bin")))
    return own.select("lang", "column", (F.array_min(places)["bin"] / 4).alias("limit"))


def truncated(df: DataFrame, id_col: str, text_col: str | Sequence[str], lang_col: str | None = None, source_col: str | None = None) -> DataFrame:
    """Every text that isn't null or blank, of one or several columns, with cut: id, column, source, lang, odds, cut
    BOOLEAN.

    A text is cut if its end has log-odds below the threshold of its language and column (see thresholds). Repeated rows
    give repeated rows only if they differ in the columns named. A text of one character has no context and isn't cut.
    Other columns are ignored, whatever their names.
    """
    scores = stage(end_scores(df, id_col, text_col, lang_col, source_col), "truncation-scores")
    limits = thresholds(scores)
    return scores.join(limits, ["lang", "column"], "left").withColumn("cut", F.coalesce(F.col("odds") < F.col("limit"), F.lit(False))).select("id", "column", "source", "lang", "odds", "cut")


def truncation_rates(df: DataFrame, id_col: str, text_col: str | Sequence[str], source_col: str, lang_col: str | None = None) -> DataFrame:
    """For each source: n_texts (neither null nor blank), n_cut, share (rounded to 6 places)."""
    found = truncated(df, id_col, text_col, lang_col, source_col)
    n_cut = F.count_if("cut")
    return found.groupBy("source").agg(F.count("*").alias("n_texts"), n_cut.alias("n_cut"), F.round(n_cut / F.count("*"), 6).alias("share"))
