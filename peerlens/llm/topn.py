"""Problem 2: the N best items of every group, by a loser-tree merge of sorted runs.

Map side: Spark sorts each partition by bucket, group, descending score and item (external, spilling); groups come in the
order of a 64-bit hash. Every Arrow batch of a sorted partition is a sorted run. From each run only the first N
different items of each group are kept, which loses nothing, as an item outside the first N of a run can't be among the
first N of all runs. So a group of any size sends at most N rows per run. What is left of a run is stored in pages, each
with its bucket and the hash of its first group.

Reduce side: a task takes a bucket and reads its pages by the hash of their first groups. Before a page is opened, a
loser tree merges the open ones up to that hash; after N outputs of a group, every run seeks to its next group, without
looking at the rows between. So a task holds only pages that overlap, however large its bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.plans import shuffle_partitions

_END = (float("inf"),)
#: Rows of a page.
PAGE = 2_048


class LoserTree:
    """Tournament tree over k sources: `key(i)` is the current key of source i, None at its end. winner is the source
    with the smallest key; replay() after the winner's key has changed costs log2(k) comparisons."""

    def __init__(self, keys: list):
        self.k = max(1, len(keys))
        self.keys = [_END if x is None else x for x in keys] or [_END]
        self.losers = [0] * self.k
        winners = [0] * (2 * self.k)
        winners[self.k :] = range(self.k)
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self.keys[b] < self.keys[a]:
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if self.k > 1 else 0

    def replay(self, key: tuple | None) -> None:
        """Sets the key of the winner's source and finds the new winner."""
        keys, losers, w = self.keys, self.losers, self.winner
        keys[w] = _END if key is None else key
        node = (w + self.k) >> 1
        while node:
            other = losers[node]
            if keys[other] < keys[w]:
                losers[node], w = w, other
            node >>= 1
        self.winner = w

    @property
    def done(self) -> bool:
        return self.keys[self.winner] is _END


def _changes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """True where a row's values differ from those of the row before; nulls equal nulls."""
    out = np.zeros(batch.num_rows, dtype=bool)
    if batch.num_rows:
        out[0] = True
    for name in names:
        c = batch.column(name)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        nulls = pc.xor(a.is_null(), b.is_null())
        out[1:] |= pc.or_(differ, nulls).to_numpy(zero_copy_only=False)
    return out


def _runs(n: int, groups: list[str]):
    """Arrow batches of a sorted partition to pages (bucket, first, page)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            segment = np.cumsum(_changes(batch, ["bucket", "hash", *groups]))
            item = batch.column("item").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = ~pd.DataFrame({"s": segment, "i": item}).duplicated().to_numpy()
            counted = np.cumsum(new)
            first = np.flatnonzero(np.diff(segment, prepend=0))
            before = (counted - new)[first][segment - 1]
            kept = batch.filter(pa.array(new & (counted - before <= n)))
            bucket, body = kept.column("bucket").to_numpy(), kept.drop_columns(["bucket"])
            edges = np.union1d(np.flatnonzero(np.diff(bucket, prepend=-1)), np.arange(0, len(bucket), PAGE))
            out = []
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, body.schema) as w:
                    w.write_batch(body.slice(a, b - a))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int32()), kept.column("hash").take(pa.array(edges)), pa.array(out, pa.binary())], ["bucket", "first", "page"])

    return run


class _Page:
    """A page that is being merged: its groups, last first, and where it stands."""

    def __init__(self, rows: pa.RecordBatch, groups: list[str], codes: dict[int, dict[tuple, int]]):
        first = np.flatnonzero(_changes(rows, ["hash", *groups]))
        heads = rows.take(pa.array(first))
        self.score, self.item = (-rows.column("score").to_numpy()).tolist(), rows.column("item").to_pylist()
        todo = []
        for h, a, b, *group in zip(heads.column("hash").to_pylist(), first.tolist(), [*first[1:].tolist(), rows.num_rows], *(heads.column(g).to_pylist() for g in groups)):
            known = codes.setdefault(h, {})
            todo.append((h, known.setdefault(tuple(group), len(known)), a, b, tuple(group)))
        self.todo = sorted(todo, key=lambda x: x[:2], reverse=True)
        self.seek()

    def seek(self) -> tuple | None:
        """Goes to the start of the next group; the key of its first row."""
        if not self.todo:
            self.key = None
        else:
            self.hash, self.code, self.at, self.end, self.group = self.todo.pop()
            self.key = (self.hash, self.code, self.score[self.at], self.item[self.at])
        return self.key

    def step(self) -> tuple | None:
        """Goes to the next row."""
        self.at += 1
        if self.at == self.end:
            return self.seek()
        self.key = (self.hash, self.code, self.score[self.at], self.item[self.at])
        return self.key


class Merger:
    """The first n different items of each group over pages that are added by the hash of their first group."""

    def __init__(self, n: int, groups: list[str]):
        self.n, self.groups = n, groups
        self.open: list[_Page] = []
        self.codes: dict[int, dict[tuple, int]] = {}

    def add(self, rows: pa.RecordBatch) -> None:
        self.open.append(_Page(rows, self.groups, self.codes))

    def before(self, limit: float) -> Iterator[tuple]:
        """Rows (*group, item, score, rank) of all groups with a hash below the limit."""
        if not any(p.key[0] < limit for p in self.open):
            return
        tree = LoserTree([p.key for p in self.open])
        current, taken = None, set()
        while not tree.done and tree.keys[tree.winner][0] < limit:
            page = self.open[tree.winner]
            if (page.hash, page.code) != current:
                if current and page.hash != current[0]:
                    self.codes.pop(current[0], None)
                current, taken = (page.hash, page.code), set()
            if len(taken) < self.n:
                if (item := page.item[page.at]) not in taken:
                    taken.add(item)
                    yield (*page.group, item, -page.score[page.at], len(taken))
                tree.replay(page.step())
            else:
                tree.replay(page.seek())
        if current:
            self.codes.pop(current[0], None)
        self.open = [p for p in self.open if p.key is not None]


def _merge(n: int, groups: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, merger, rows = None, Merger(n, groups), []
        schema = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for at, first, page in zip(batch.column("bucket").to_pylist(), batch.column("first").to_pylist(), batch.column("page")):
                body = pa.ipc.open_stream(page.as_buffer()).read_next_batch()
                schema = schema or pa.schema([*(body.schema.field(g) for g in groups), body.schema.field("item"), body.schema.field("score"), pa.field("rank", pa.int32())])
                rows += merger.before(first if at == bucket else float("inf"))
                bucket = at
                merger.add(body)
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
        rows += merger.before(float("inf"))
        if rows:
            yield batch_of(rows)

    return run


def top_n_per_group(df: DataFrame, group_cols: Sequence[str | Column], item: str | Column, score: str | Column, n: int, group_names: Sequence[str] | None = None) -> DataFrame:
    """The n items with the highest scores of every group: columns of the group, item, score, rank (from 1).

    An item counts once per group, with its highest score. Equal scores are ordered by ascending item, so the result
    is the same for any order and partitioning of the rows. Rows with a null item, a null score or a NaN score don't
    take part; a null in a group column is a value like any other. Infinite scores take part. Groups of fewer than n
    items come out whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be positive")
    groups = [f"g{i}" for i in range(len(group_cols))]
    names = list(group_names or [g if isinstance(g, str) else f"group_{i}" for i, g in enumerate(group_cols)])
    col = lambda c: df[c] if isinstance(c, str) else c
    rows = df.select(*(col(c).alias(g) for c, g in zip(group_cols, groups)), col(item).alias("item"), col(score).cast("double").alias("score"))
    rows = rows.where("item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").withColumn("score", F.col("score") + F.lit(0.0))
    buckets = shuffle_partitions(df.sparkSession)
    rows = rows.withColumn("hash", F.xxhash64(*groups)).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    ordered = rows.sortWithinPartitions("bucket", "hash", *groups, F.desc("score"), "item")
    pages = ordered.mapInArrow(_runs(n, groups), "bucket INT, first BIGINT, page BINARY")
    schema = T.StructType([*(rows.schema[g] for g in groups), rows.schema["item"], rows.schema["score"], T.StructField("rank", T.IntegerType())])
    merged = pages.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "first").mapInArrow(_merge(n, groups), schema)
    return merged.select(*(F.col(g).alias(x) for g, x in zip(groups, names)), "item", "score", "rank")


def padded_id(c: Column) -> Column:
    """A firm id with ten digits; null if it is null or blank."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", F.when(F.length(t) < 10, F.lpad(t, 10, "0")).otherwise(t))
