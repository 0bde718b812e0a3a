"""Problem 7: documents that hold passages of held-out items, by CGK embedding and bit-sampling LSH.

The symbols are words. Windows of item size (as many words as must be shared) are embedded by the CGK random walk:
output step j repeats the current symbol, and a random bit of (j, symbol) decides whether the walk moves on. So edit
distance becomes Hamming distance, and hashing a random sample of the output steps is a locality-sensitive hash. Each
repetition has its own walk and its own sample. Windows at distance 0 collide in every repetition; for windows at a
greater distance the repetitions are as many as it takes to find the wanted share of simulated windows with the worst
kind of edits. Every collision is verified by the exact edit distance of the two windows.

The held-out windows are a stated query set: their number is checked, and beyond a bound they are worked off in
blocks. The corpus is only streamed; it is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.kernels import U64, Words, mix, text_blocks

#: Held-out items, and characters of their passages, that are sent to the workers at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 50_000_000
#: Repetitions at distance 0, where each has recall 1: a window must collide in all of them to be verified.
EXACT_REPETITIONS = 2
#: Simulated windows of each kind of edits, and repetitions tried on them.
SIMULATED, MOST_REPETITIONS = 4_000, 256
_TABLE_BITS = 22


def cgk_keys(hashes: np.ndarray, at: np.ndarray, size: int, repetition: int, sampled: int) -> np.ndarray:
    """LSH keys of the windows of `size` words that begin at `at`, for one repetition."""
    random = np.random.default_rng(7_000 + repetition)
    steps = 3 * size
    odd = random.integers(1, 1 << 63, steps, dtype=np.uint64) * U64(2) + U64(1)
    chosen = set(random.choice(2 * size, min(sampled, 2 * size), replace=False).tolist())
    at = at.astype(np.int64)
    place, end = at.copy(), at + size
    key = np.full(len(at), 0x243F6A8885A308D3 + repetition, dtype=U64)
    padded = np.append(hashes, U64(0))
    none = len(padded) - 1
    for j in range(max(chosen) + 1):
        symbol = padded[np.where(place < end, place, none)]
        if j in chosen:
            key = key * U64(0x9E3779B97F4A7C15) + symbol
            key ^= key >> U64(29)
        place += ((symbol * odd[j]) >> U64(63)).astype(np.int64)
    return mix(key)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word insertions, deletions and replacements between rows of a and b (windows of the same size), or most + 1 if
    there are more: the banded recursion, for all rows at once."""
    n, size = a.shape
    if not most:
        return (a != b).any(axis=1).astype(np.int64)
    width, far = 2 * most + 1, most + 1
    # row i of the table holds columns i - most .. i + most; those outside count as too far
    row = np.full((n, width), far, dtype=np.int64)
    row[:, most:] = np.minimum(np.arange(most + 1), far)
    for i in range(1, size + 1):
        new = np.full((n, width), far, dtype=np.int64)
        for k in range(width):
            j = i - most + k
            if not 0 <= j <= size:
                continue
            best = np.full(n, far, dtype=np.int64) if j else np.full(n, min(i, far), dtype=np.int64)
            if j:
                best = row[:, k] + (a[:, i - 1] != b[:, j - 1])
                if k:
                    best = np.minimum(best, new[:, k - 1] + 1)
            if k + 1 < width:
                best = np.minimum(best, row[:, k + 1] + 1)
            new[:, k] = np.minimum(best, far)
        row = new
    return row[:, most]


@lru_cache(maxsize=16)
def repetitions_for(size: int, edits: int, sampled: int, recall: float) -> int:
    """Repetitions until the share `recall` of simulated windows with `edits` edits has collided: as many as the worst
    mixture of replacements and of insertions that each push a word out takes."""
    if not edits:
        return EXACT_REPETITIONS
    random = np.random.default_rng(11)
    rows = np.arange(SIMULATED)
    left = random.integers(1, 1 << 63, (SIMULATED, size), dtype=np.uint64)
    needed = 0
    for moved in range(edits // 2 + 1):
        right = left.copy()
        for _ in range(moved):
            out, into = random.integers(0, size, SIMULATED), random.integers(0, size, SIMULATED)
            column = np.arange(size - 1)
            short = np.take_along_axis(right, column + (column >= out[:, None]), axis=1)
            long = np.take_along_axis(np.pad(short, ((0, 0), (0, 1))), np.arange(size) - (np.arange(size) > into[:, None]), axis=1)
            long[rows, into] = random.integers(1, 1 << 63, SIMULATED, dtype=np.uint64)
            right = long
        for _ in range(edits - 2 * moved):
            right[rows, random.integers(0, size, SIMULATED)] = random.integers(1, 1 << 63, SIMULATED, dtype=np.uint64)
        found, tried = np.zeros(SIMULATED, dtype=bool), 0
        while found.mean() < recall:
            if tried >= MOST_REPETITIONS:
                raise ValueError(f"windows of {size} words with {edits} edits don't reach a recall of {recall}: sample fewer steps than {sampled}")
            found |= cgk_keys(left.ravel(), rows * size, size, tried, sampled) == cgk_keys(right.ravel(), rows * size, size, tried, sampled)
            tried += 1
        needed = max(needed, tried)
    return needed


class _Items:
    """The windows of a block of held-out items, by LSH key, for lookups in a worker."""

    def __init__(self, items: list[tuple[int, str]], size: int, edits: int, sampled: int, repetitions: int):
        self.items, self.words = [i for i, _ in items], Words([t for _, t in items])
        self.at = self.words.windows(size)
        self.tables = []
        for r in range(repetitions):
            keys = cgk_keys(self.words.hashes, self.at, size, r, sampled)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _TABLE_BITS, dtype=bool)
            seen[keys >> U64(64 - _TABLE_BITS)] = True
            self.tables.append((keys[order], order, seen))
        self.size, self.edits, self.sampled = size, edits, sampled

    def _collisions(self, words: Words, at: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window of `at` and an own window whose keys agree in repetition r."""
        keys, order, seen = self.tables[r]
        own = cgk_keys(words.hashes, at, self.size, r, self.sampled)
        maybe = np.flatnonzero(seen[own >> U64(64 - _TABLE_BITS)])
        lo, hi = np.searchsorted(keys, own[maybe], "left"), np.searchsorted(keys, own[maybe], "right")
        n = hi - lo
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(maybe, n), order[np.repeat(lo, n) + rank]

    def find(self, texts: list[str]) -> dict[tuple[int, int], int]:
        """(index of the text, item) with the smallest edit distance of their windows."""
        words = Words(texts)
        at = words.windows(self.size)
        if not len(at) or not len(self.at):
            return {}
        if self.edits:
            pairs = [self._collisions(words, at, r) for r in range(len(self.tables))]
            mine, other = (np.concatenate(x) for x in zip(*pairs))
            mine, other = np.divmod(np.unique(mine * len(self.at) + other), len(self.at))
        else:
            mine, other = np.arange(len(at)), None
            for r in range(len(self.tables)):
                hit, other = self._collisions(words, at[mine], r)
                mine = mine[hit] if r + 1 == len(self.tables) else mine[np.unique(hit)]
        best: dict[tuple[int, int], int] = {}
        span = np.arange(self.size)
        for s in range(0, len(mine), 20_000):
            m, o = at[mine[s : s + 20_000]], self.at[other[s : s + 20_000]]
            far = edit_distances(words.hashes[m[:, None] + span], self.words.hashes[o[:, None] + span], self.edits)
            order = np.argsort(far, kind="stable")
            order = order[far[order] <= self.edits]
            doc, item = words.doc[m[order]], self.words.doc[o[order]]
            _, first = np.unique(doc * len(self.items) + item, return_index=True)
            for d, i, x, p, q in zip(doc[first].tolist(), item[first].tolist(), far[order[first]].tolist(), m[order[first]], o[order[first]]):
                # equal hashes are checked on the words themselves
                if x or words.spelled(int(p), self.size) == self.words.spelled(int(q), self.size):
                    name = (d, self.items[i])
                    best[name] = min(x, best.get(name, x))
        return best


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, words: int = 13, edits: int = 0, sampled: int | None = None, recall: float = 0.95, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Documents and the held-out items of which they hold a window: doc id and item id (under their own names), and
    edits, the smallest edit distance found between windows of the two.

    With edits = 0 a document matches if it shares at least `words` consecutive words with the passage; exact, no
    miss and no false match. With edits > 0 a window of `words` words may differ from the item's by that many word
    edits, and is found with probability `recall` or more; matches are exact. Words are longest runs of ASCII letters
    and digits of the lower-cased text. One row for each pair. Null, empty and shorter texts and passages match nothing;
    rows without id are left out; repeated rows count once. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    sampled = sampled or (min(12, 2 * words) if edits else min(16, 2 * words))
    repetitions = repetitions_for(words, edits, sampled, recall)
    left = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    right = items.select(items[item_id].alias("item"), items[passage].alias("passage")).where("item IS NOT NULL AND passage IS NOT NULL").distinct()
    kinds = left.schema["id"].dataType.simpleString(), right.schema["item"].dataType.simpleString()
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size.n // block_items), -(-size.chars // BLOCK_CHARS))
    right = right.withColumn("part", F.pmod(F.hash("item", "passage"), F.lit(parts)))
    out = None
    for part in range(parts):
        block = [(r.item, r.passage) for r in right.where(F.col("part") == part).select("item", "passage").collect()]
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = _Items(sent.value, words, edits, sampled, repetitions)
            for batch in batches:
                ids = batch.column(0)
                for a, _, texts in text_blocks(batch.column(1)):
                    if pairs := known.find(texts):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + d for d, _ in pairs])), pa.array([i for _, i in pairs]), pa.array(list(pairs.values()), pa.int32())], ["id", "item", "edits"])

        found = left.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, edits INT")
        out = found if out is None else out.unionAll(found)
    return out.groupBy("id", "item").agg(F.min("edits").alias("edits")).select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "edits")
