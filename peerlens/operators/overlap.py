"""Peers ranked by vectors and by the words that their texts share, without a row for each pair on the way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.config import COSINE_WEIGHT, MAX_CHARS, RERANK_WEIGHT
from peerlens.functions import text as X
from peerlens.plans import shuffle_partitions, stage

#: Focal firms of a year that are ranked in one task.
FOCALS = 256
_RANKED = "peer_firm STRING, items_matched BIGINT, avg_cosine DOUBLE, avg_rerank DOUBLE, avg_item_score DOUBLE, coverage_share DOUBLE, final_score DOUBLE, rank INT"


def half_away(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded as SQL does: the product with the power of ten, halves away from zero."""
    y = x * 10.0**places
    t = np.trunc(y)
    return np.where(np.abs(y - t) >= 0.5, t + np.copysign(1.0, y), t) / 10.0**places


def overlap_ranking(vectors: DataFrame, texts: DataFrame, focal: Column, requested_items: int, most: int = MAX_CHARS) -> DataFrame:
    """What final_ranking makes, with top_share None, of all other firms of an item and year as candidates whose
    rerank_score is the share of common words of the two texts, in percent rounded to 4 places.

    vectors: firm, year, item_id, vec; one row each. texts: firm, text; one row for each firm. Only firms with a vector and a
    text that is not blank take part. Texts are cut to `most` characters. All items of a year and share of its focal firms
    are ranked in one task that holds the vectors and words of the year, and only the ranked peers leave it.
    """
    # words hold no white space; as one string they are half as large as in a list
    words = F.array_join(F.array_distinct(X.words(F.lower(X.head_and_tail(F.col("text"), most)))), " ")
    told = texts.where(F.rlike("text", F.lit(X.NOT_WS))).select("firm", words.alias("words"))
    given = vectors.where("vec IS NOT NULL").select("firm", "year", "item_id", "vec", F.coalesce(focal, F.lit(False)).alias("asked"))
    rows = stage(given.join(told, "firm"), "overlap")
    shares = rows.where("asked").groupBy("year").agg(F.ceil(F.count_distinct("firm") / FOCALS).cast("int").alias("shares"))
    rows = rows.join(shares, "year").withColumn("own", F.pmod(F.xxhash64("firm"), F.col("shares")).cast("int"))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("asked", F.expr("asked AND own = share"))
    dealt = rows.select("year", "share", "item_id", "firm", "vec", "words", "asked").repartition(4 * shuffle_partitions(vectors.sparkSession), "year", "share")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return dealt.sortWithinPartitions("year", "share", "item_id", "firm").mapInArrow(_by_share(requested_items), f"focal_firm {kind['firm']}, year {kind['year']}, {_RANKED}")


def _by_share(requested: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("year").to_pylist(), table.column("share").to_pylist()))
            start = 0
            for i in range(len(keys)):
                if keys[i] != now:
                    if i > start:
                        held.append(table.slice(start, i - start))
                    if held:
                        yield from _ranked(pa.concat_tables(held), requested)
                    held, now, start = [], keys[i], i
            held.append(table.slice(start))
        if held:
            yield from _ranked(pa.concat_tables(held), requested)

    return run


def _ranked(table: pa.Table, requested: int) -> Iterator[pa.RecordBatch]:
    """The ranked peers of each asked firm, firm by firm; table: one year, sorted by item."""
    asked = np.flatnonzero(table.column("asked").to_numpy(zero_copy_only=False))
    if not len(asked):
        return
    year = table.column("year")[0]
    names, firm = np.unique(table.column("firm").to_numpy(zero_copy_only=False), return_inverse=True)
    names = pa.array(names, table.schema.field("firm").type)
    item = table.column("item_id").combine_chunks().dictionary_encode().indices.to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vec = flat.reshape(len(table), -1)
    vec = vec / (np.sqrt((vec * vec).sum(axis=1)) + 1e-12)[:, None]
    lists = pc.split_pattern(table.column("words").combine_chunks(), " ")
    size = lists.value_lengths().to_numpy()
    ends = np.cumsum(size, dtype=np.int64)
    begins = ends - size
    word = lists.flatten().dictionary_encode()
    mark, word = np.zeros(len(word.dictionary), dtype=bool), word.indices.to_numpy()
    first, last = np.searchsorted(item, item[asked]), np.searchsorted(item, item[asked], side="right")

    for one in np.unique(firm[asked]):
        found = []
        for k in np.flatnonzero(firm[asked] == one):
            i, s, e = asked[k], first[k], last[k]
            mine = word[begins[i] : ends[i]]
            mark[mine] = True
            common = np.add.reduceat(mark[word[begins[s] : ends[e - 1]]], begins[s:e] - begins[s], dtype=np.int64)
            mark[mine] = False
            score = half_away(100 * common / (size[i] + size[s:e] - common), 4) / 100
            found.append((firm[s:e], np.round(vec[s:e] @ vec[i], 6) + 0.0, score))
        peer, cosine, score = (np.concatenate(x) for x in zip(*found))
        n = np.bincount(peer, minlength=len(names))
        n[one] = 0
        there = np.flatnonzero(n)
        if not len(there):
            continue
        n = n[there]
        mean = lambda x: half_away(np.bincount(peer, x, len(names))[there] / n, 6)
        cos, rerank, mixed = mean(cosine), mean(score), mean(cosine * COSINE_WEIGHT + score * RERANK_WEIGHT)
        coverage = half_away(n / max(1, requested), 6)
        final = half_away(mixed * coverage, 6)
        order = np.lexsort((there, -cos, -rerank, -final))
        columns = [pa.repeat(names[int(one)], len(there)), pa.repeat(year, len(there)), names.take(pa.array(there[order])), *(pa.array(x[order]) for x in (n, cos, rerank, mixed, coverage, final)), pa.array(np.arange(1, len(there) + 1, dtype=np.int32))]
        yield pa.record_batch(columns, ["focal_firm", "year", *(c.split()[0] for c in _RANKED.split(", "))])
