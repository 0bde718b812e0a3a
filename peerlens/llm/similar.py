"""Problem 4: records that are edited copies of each other, by odd sketches over banded MinHash candidates.

1. One pass over the texts gives, for each record, a name of its word sequence, a MinHash sample of its word
   shingles, band keys over that sample, and the odd sketch: each sample (i, value) flips one bit of a small bitmap, so
   the XOR of two bitmaps holds the parity of their differences and its population count tells the similarity.
2. Records with the same words become one class.
3. Band keys that occur once are dropped by a pre-aggregated count. Within the others, sketches are compared block by
   block; a key with many members is cut into blocks whose pairs of blocks are spread over tasks.
4. Pairs whose sketches are close enough are verified exactly on the shingle sets of the texts.
5. Classes are written out again, by words or by text (see `copies` of similar_pairs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.kernels import BASE, U64, Words, mix, prefix_hash, span_hash, text_blocks
from peerlens.plans import shuffle_partitions, stage

SAMPLES, BITS = 256, 1024
#: Members of a key that are compared with each other in one step.
BLOCK = 2_048
#: Texts of one side of a cell, in which pairs are verified.
CELL = 2_048
#: Pairs within small keys, and their bytes of sketches, that are compared at once.
PAIRED, SMALL = 50_000, 32
#: Copies that are all named in pairs; of more copies each is paired with the first one only.
EXPAND = 32


def _constants() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, SAMPLES + 1, dtype=U64)
    return mix(i * U64(0xA24BAED4963EE407)) | U64(1), mix(i * U64(0x9FB21C651E98DF25))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The MinHash sample of a set of 64-bit shingles."""
    a, b = _constants()
    out = np.full(SAMPLES, np.iinfo(U64).max, dtype=U64)
    for i in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[i : i + 2048, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """The band keys of each row of samples."""
    bands = samples[:, : SAMPLES // rows * rows].reshape(len(samples), SAMPLES // rows, rows)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F), bands.shape[:2])
    for r in range(rows):
        key = mix(key * U64(BASE) + bands[:, :, r])
    return key


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of each row of samples, packed in bytes."""
    bit = (mix(samples ^ (np.arange(1, SAMPLES + 1, dtype=U64) * U64(0x165667B19E3779F9))) % U64(BITS)).astype(np.int64)
    flips = np.bincount((bit + np.arange(len(samples))[:, None] * BITS).ravel(), minlength=len(samples) * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(samples), BITS), axis=1)


def differing_bits(similarity: float) -> float:
    """Bits in which the sketches of two sets of this similarity are expected to differ."""
    return BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - similarity)))


def sketch_limit(threshold: float) -> int:
    """Bits up to which a pair is verified: four standard deviations above what the threshold gives."""
    p = differing_bits(threshold) / BITS
    sampling = 2 * (SAMPLES * threshold * (1 - threshold)) ** 0.5 * (1 - 2 * p)
    return int(differing_bits(threshold) + 4 * (sampling**2 + BITS * p * (1 - p)) ** 0.5)


def _features(shingle: int, least_words: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column(0), batch.column(2)
            for a, b, texts in text_blocks(batch.column(1)):
                w = Words(texts)
                h, doc = w.shingles(shingle)
                first = np.searchsorted(doc, np.arange(b - a + 1))
                use = np.flatnonzero(np.diff(w.first) >= max(least_words, shingle))
                one, two = prefix_hash(w.hashes), prefix_hash(mix(w.hashes ^ U64(BASE)))
                lo, hi = w.first[use], w.first[use + 1]
                samples = np.empty((len(use), SAMPLES), dtype=U64)
                for i, d in enumerate(use):
                    samples[i] = min_hashes(h[first[d] : first[d + 1]])
                each, sketches = SAMPLES // rows, odd_sketches(samples)
                flat = band_keys(samples, rows).view(np.int64).ravel()
                at = np.arange(len(use) + 1, dtype=np.int32) * (BITS // 8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(use + a)),
                        pa.array(span_hash(one, lo, hi).view(np.int64)),
                        pa.array(span_hash(two, lo, hi).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(use) + 1, dtype=np.int32) * each), pa.array(flat)),
                        pa.Array.from_buffers(pa.binary(), len(use), [None, pa.py_buffer(at), pa.py_buffer(sketches)]),
                        copies.take(pa.array(use + a)),
                    ],
                    ["id", "name1", "name2", "keys", "sketch", "copy"],
                )

    return run


def _close(a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sketches differ in at most `limit` bits."""
    out = []
    for i in range(0, len(a), 64):
        bits = np.bitwise_count(a[i : i + 64, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32)
        x, y = np.nonzero(bits <= limit)
        out.append((x + i, y))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _within(sketches: np.ndarray, first: np.ndarray, size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within many small groups of rows whose sketches differ in at most `limit` bits."""
    out = []
    for m in np.unique(size):
        x, y = np.triu_indices(m, 1)
        start = first[size == m]
        step = max(1, PAIRED // len(x))
        for s in range(0, len(start), step):
            a, b = ((start[s : s + step, None] + side).ravel() for side in (x, y))
            near = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int32) <= limit
            out.append((a[near], b[near]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _compare(limit: int):
    """Rows sorted by (key, i, j), with the block of each row, to pairs of ids with close sketches. A pair of blocks is
    compared as a whole; what a batch ends with waits for the rest of it."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("id").combine_chunks()
        key, i, j, block = (rows.column(c).to_numpy() for c in ("key", "i", "j", "block"))
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(key), -1)
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        size = np.diff(np.append(first, len(key)))
        small = (size > 1) & (size <= SMALL) & (i[first] == j[first])
        found = [_within(sketches, first[small], size[small], limit)] if small.any() else []
        for f, n in zip(first[(size > 1) & ~small], size[(size > 1) & ~small]):
            own = np.arange(f, f + n)
            left, right = own[block[f : f + n] == i[f]], own[block[f : f + n] == j[f]]
            if len(left) and len(right):
                x, y = _close(sketches[left], sketches[right], limit)
                found.append((left[x], right[y]))
        x, y = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        code = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        swap = code[x] > code[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        _, one = np.unique(code[x] * (len(ids) + 1) + code[y], return_index=True)
        one = one[code[x[one]] != code[y[one]]]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x[one])), ids.take(pa.array(y[one]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, dtype=bool)
            for c in ("key", "i", "j"):
                of = batch.column(c).to_numpy()
                same &= of == of[-1]
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            whole = held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("key", "i", "j"))
            if cut or whole:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _verify(shingle: int, threshold: float):
    """Rows sorted by cell, with the texts of a cell (id in a, text) before its pairs (a, b), to the pairs whose sets of
    shingles have the similarity. Each text of a cell is taken apart once."""
    over, under = round(threshold * 1_000_000), 1_000_000

    def sets_of(texts: pa.Array) -> list[np.ndarray]:
        out = []
        for a, b, block in text_blocks(texts):
            h, doc = Words(block).shingles(shingle)
            edges = np.searchsorted(doc, np.arange(b - a + 1))
            out += [np.unique(h[x:y]) for x, y in zip(edges, edges[1:])]
        return out

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        # the smaller set bounds what both can share
        if min(len(x), len(y)) * under < over * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and both * under >= over * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            is_text = batch.column("text").is_valid()
            sets = iter(sets_of(batch.column("text").filter(is_text)))
            keep = np.zeros(batch.num_rows, dtype=bool)
            columns = (batch.column("cell").to_pylist(), is_text.to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist())
            for i, (cell, text, a, b) in enumerate(zip(*columns)):
                if cell != now:
                    now, known = cell, {}
                if text:
                    known.setdefault(a, []).append(next(sets))
                else:
                    keep[i] = any(alike(x, y) for x in known[a] for y in known[b])
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def similar_pairs(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, least_words: int = 20, rows: int = 4, expand: int = EXPAND, copies: str = "words") -> DataFrame:
    """Pairs (row_a, row_b), row_a < row_b, of ids whose sets of `shingle`-word sequences have a Jaccard similarity of
    at least `threshold`.

    Words are longest runs of ASCII letters and digits of the lower-cased text. Texts of fewer than `least_words`
    words, null texts and rows without id take no part. An id is never paired with itself, however often it occurs.
    Every pair is verified exactly. With `rows` samples a band and SAMPLES // rows bands, a pair at the threshold is
    missed with probability (1 - threshold**rows)**(SAMPLES // rows): 0.0001 for 0.6 and 4. Of copies, all pairs are
    listed up to `expand` of them; of more, every one is paired with the smallest id among them, and that id alone stands
    for them in all other pairs. `copies` says what a copy is: with "text" the same text to the character, so that only
    pairs of exact copies are left out and all pairs of different texts are listed; with "words" the same words, which
    keeps every link between texts of different words but not every pair, and is enough for components.
    """
    if copies not in ("text", "words"):
        raise ValueError(f"copies must be text or words, not {copies}")
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    copy = F.unhex(F.md5("text")) if copies == "text" else F.lit(b"")
    features = stage(texts.withColumn("copy", copy).mapInArrow(_features(shingle, least_words, rows), f"id {kind}, name1 BIGINT, name2 BIGINT, keys ARRAY<BIGINT>, sketch BINARY, copy BINARY"), "similar-features")

    same = features.groupBy("name1", "name2", "copy").agg(F.min("id").alias("first"), F.count_distinct("id").alias("size"))
    classes = features.groupBy("name1", "name2").agg(F.min("id").alias("rep"))
    members = features.select("id", "name1", "name2", "copy").join(same, ["name1", "name2", "copy"]).join(classes, ["name1", "name2"])
    members = stage(members.select("id", "rep", "first", "size").distinct(), "similar-members")
    reps = features.join(members.where("id = rep").select("id"), "id", "left_semi")

    keys = reps.select("id", F.explode("keys").alias("key"))
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    alive = keys.join(many, "key").join(reps.select("id", "sketch"), "id")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), parts).cast("int")
    spread = alive.withColumn("parts", parts).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "sketch")
    spread = spread.repartition(shuffle_partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    close = stage(spread.mapInArrow(_compare(sketch_limit(threshold)), f"a {kind}, b {kind}").distinct(), "similar-close")

    # pairs are dealt to cells by the hashes of both ids, so that a text is sent once to each cell that has pairs of it
    sides = max(1, -(-features.count() // CELL))
    side = lambda x: F.pmod(F.xxhash64(x), F.lit(sides))
    dealt = close.withColumn("cell", side("a") * F.lit(sides) + side("b"))
    wanted = dealt.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct()
    sent = wanted.join(texts.select("id", "text"), "id").select("cell", F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "text")
    rows_ = sent.unionByName(dealt.select("cell", "a", "b", F.lit(None).cast("string").alias("text")))
    rows_ = rows_.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", F.col("text").isNull())
    linked = rows_.mapInArrow(_verify(shingle, threshold), f"a {kind}, b {kind}")

    named = members.where((F.col("size") <= expand) | (F.col("id") == F.col("first"))).select("rep", "id").distinct()
    side = lambda x: named.select(F.col("rep").alias(x), F.col("id").alias(f"{x}_id"))
    across = linked.join(side("a"), "a").join(side("b"), "b").select("a_id", "b_id")
    within = named.select("rep", F.col("id").alias("a_id")).join(named.select("rep", F.col("id").alias("b_id")), "rep").where("a_id < b_id").select("a_id", "b_id")
    star = members.where((F.col("size") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("a_id"), F.col("id").alias("b_id"))
    every = across.unionByName(within).unionByName(star).where("a_id <> b_id")
    return every.select(F.least("a_id", "b_id").alias("row_a"), F.greatest("a_id", "b_id").alias("row_b")).distinct()
