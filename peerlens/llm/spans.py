"""Problem 5: long stretches of characters that stand word for word in more than one record.

MinHash banding over paragraphs can't give this result: a stretch may lie across paragraph ends or fill a tenth of
each of two paragraphs, whose MinHashes then never meet. So the units are not paragraphs but all windows of `span`
characters. The MinHash of a window is the smallest hash among its character grams; equal windows have the same one,
so one band of one row has recall 1 (and neighbouring windows mostly share it, which keeps the number of keys at about
two in a hundred characters). Runs of neighbouring windows whose key occurs in several records are the candidates.
They are verified by 64-bit hashes of their content: a run that stands in several records is shared as a whole; of the
others, which lie where a shared stretch begins or ends, the windows are compared with those of the same key. The
verified windows of each record are joined into its components, the unbroken stretches.

No step lists pairs. Keys, runs and windows only ask whether their smallest and largest record id differ, which Spark
pre-aggregates before the shuffle. The windows of one key are compared in one task as long as there are few runs; of a
crowded key each window is a row of its own and takes the pre-aggregated way. So a stretch that stands in a third of all
records costs no more than any other. Records with the same text are first reduced to one. The texts themselves are
shuffled once, and only those that have windows to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerlens.llm.kernels import U64, char_values, code_points, mix, prefix_hash, sliding_min, span_hash, text_blocks, window_hash
from peerlens.plans import shuffle_partitions, stage

#: Runs of a key that are compared in one task; keys with more take the way of single windows.
CROWDED = 4_096
#: Windows that are compared at once.
COMPARED = 400_000


class _Windows:
    """The windows of a block of texts: text and start of each, MinHash of its grams, prefix hashes for its content."""

    def __init__(self, texts: list[str], span: int, gram: int):
        codes, self.starts = code_points(texts)
        self.prefix = prefix_hash(char_values()[codes])
        least = sliding_min(window_hash(self.prefix, gram), span - gram + 1)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.starts))
        self.at = np.flatnonzero(doc[: len(doc) - span] == doc[span:]) if len(doc) > span else np.zeros(0, dtype=np.int64)
        self.doc, self.key = doc[self.at], least[self.at]
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.key[1:] != self.key[:-1])
        #: Index of the first window of each stretch of windows with the same key.
        self.run = np.flatnonzero(new)


def _runs(span: int, gram: int):
    """Texts to their runs of windows with the same key: key, a hash of all the characters that the run covers, start
    and number of its windows. The text itself isn't sent back, only its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(1)):
                w = _Windows(texts, span, gram)
                n = np.diff(np.append(w.run, len(w.at)))
                at, doc = w.at[w.run], w.doc[w.run]
                whole = mix(span_hash(w.prefix, at, at + n - 1 + span) ^ n.astype(U64))
                offsets = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                values = (w.key[w.run].view(np.int64), whole.view(np.int64), (at - w.starts[doc]).astype(np.int32), n.astype(np.int32))
                kept = [batch.column(c).slice(a, b - a) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values)], ["id", "name", "chars", "key", "whole", "start_pos", "n"])

    return run


def _contents(span: int):
    """The listed runs of each text with the hashes of their windows; of a crowded key each window is a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in text_blocks(batch.column(1)):
                codes, starts = code_points(texts)
                content = window_hash(prefix_hash(char_values()[codes]), span).view(np.int64)
                part = batch.column(2).slice(a, b - a)
                key, begin, n, copied, crowded = (part.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("key", "start_pos", "n", "copied", "crowded"))
                doc = np.repeat(np.arange(b - a), part.value_lengths().to_numpy(zero_copy_only=False))
                for few in (True, False):
                    at = np.flatnonzero(crowded != few)
                    first = starts[doc[at]] + begin[at]
                    each = np.repeat(np.arange(len(at)), n[at])
                    pos = np.arange(len(each)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
                    hashes = content[first[each] + pos]
                    if few:
                        bounds = np.concatenate([[0], np.cumsum(n[at], dtype=np.int64)]) * 8
                        listed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(hashes)])
                        columns = [ids.take(pa.array(doc[at] + a)), pa.array(key[at]), pa.array(begin[at]), pa.array(n[at]), pa.array(copied[at]), listed]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "key", "start_pos", "n", "copied", "windows"])
                        continue
                    for x in range(0, len(each), COMPARED):
                        s = at[each[x : x + COMPARED]]
                        values = (pa.array(hashes[x : x + COMPARED]), pa.array((begin[s] + pos[x : x + COMPARED]).astype(np.int32)), pa.array(np.ones(len(s), np.int32)), pa.array(copied[s]))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[s] + a)), *values, pa.nulls(len(s), pa.binary())], ["id", "key", "start_pos", "n", "copied", "windows"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by key, with the hashes of their windows, to the stretches of windows that stand in several records:
    id, start_pos, n. Keys are taken as whole, several at once."""

    def shared(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("id").combine_chunks().dictionary_encode()
        begin, n, copied = (rows.column(c).to_numpy() for c in ("start_pos", "n", "copied"))
        hashes = np.frombuffer(b"".join(rows.column("windows").to_pylist()), np.int64)
        each = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(hashes, kind="stable")
        group = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
        owner = ids.indices.to_numpy()[each[order]]
        several = (np.minimum.reduceat(owner, group) < np.maximum.reduceat(owner, group)) | np.logical_or.reduceat(copied[each[order]], group)
        hit = np.zeros(len(each), dtype=bool)
        hit[order] = np.repeat(several, np.diff(np.append(group, len(order))))
        hit &= ~copied[each]
        edge = np.diff(hit.astype(np.int8), prepend=np.int8(0))
        first = np.flatnonzero(hit & ((edge == 1) | (pos == 0)))
        last = np.flatnonzero(hit & (np.append(~hit[1:], True) | np.append(pos[1:] == 0, True)))
        of = each[first]
        return pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().take(pa.array(of)), pa.array(begin[of] + pos[first].astype(np.int32), pa.int32()), pa.array((last - first + 1).astype(np.int32))], ["id", "start_pos", "n"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(batch.column("n").to_numpy().sum())
        if size >= COMPARED:
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield shared(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            size = sum(int(x.column("n").to_numpy().sum()) for x in held)
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield shared(rows)


def shared_spans(df: DataFrame, id_col: str, text_col: str, span: int = 200, crowded: int = CROWDED) -> DataFrame:
    """Unbroken stretches of shared characters: id (under its own name), start_pos, end_pos.

    A character is shared if it lies in a stretch of `span` characters that occurs exactly alike in a record with
    another id. Positions count code points, ends are exclusive, stretches that touch are one, rows are distinct.
    Null and shorter texts have none; rows without id are left out. Repeated rows of one id don't make each other
    shared. Other columns are ignored, whatever their names.
    """
    gram = max(1, span // 2)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(f"id IS NOT NULL AND length(text) >= {span}")
    named = rows.select("id", "text", F.unhex(F.md5("text")).alias("name"), F.length("text").alias("chars"))
    lists = "key ARRAY<BIGINT>, whole ARRAY<BIGINT>, start_pos ARRAY<INT>, n ARRAY<INT>"
    features = stage(named.mapInArrow(_runs(span, gram), f"id {kind}, name BINARY, chars INT, {lists}"), "spans-features")

    # records with the same text are shared as a whole, and one of them stands for them in what follows
    classes = features.groupBy("name").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    members = features.select("id", "name", "chars").join(classes, "name")
    whole = members.where("lo < hi").select("id", F.lit(0).alias("start_pos"), F.col("chars").alias("end_pos")).distinct()
    others = features.join(classes.select("name", F.col("lo").alias("id")), ["name", "id"], "left_semi")
    runs = others.select("id", "name", F.inline(F.arrays_zip("key", "whole", "start_pos", "n")))

    several = runs.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    alive = stage(runs.join(several, "key", "left_semi"), "spans-runs")
    wholes = alive.groupBy("key", "whole").agg(F.min(F.struct("id", "name", "start_pos")).alias("one"), (F.min("id") < F.max("id")).alias("copied"))
    found = stage(alive.join(wholes, ["key", "whole"]), "spans-found")
    # a run that stands in several records is shared as a whole; only the others, and one of each such class with a
    # key of theirs, are looked at window by window
    single = found.where("NOT copied")
    sample = found.where("copied AND struct(id, name, start_pos) = one").join(single.select("key").distinct(), "key", "left_semi")
    detail = single.unionByName(sample)
    sizes = detail.groupBy("key").agg((F.count("*") > crowded).alias("crowded"))
    detail = detail.join(sizes, "key").select("id", "name", F.struct("key", "start_pos", "n", "copied", "crowded").alias("run"))
    detail = detail.groupBy("id", "name").agg(F.collect_list("run").alias("runs"))
    asked = named.select("id", "name", "text").join(detail, ["id", "name"]).select("id", "text", "runs")
    windows = stage(asked.mapInArrow(_contents(span), f"id {kind}, key BIGINT, start_pos INT, n INT, copied BOOLEAN, windows BINARY"), "spans-windows")
    few = windows.where("windows IS NOT NULL").repartition(shuffle_partitions(df.sparkSession), "key").sortWithinPartitions("key")
    parts = few.mapInArrow(_compare, f"id {kind}, start_pos INT, n INT")
    many = windows.where("windows IS NULL")
    there = many.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.bool_or("copied").alias("any")).where("lo < hi OR any").select("key")
    parts = parts.unionByName(many.where("NOT copied").join(there, "key", "left_semi").select("id", "start_pos", "n"))
    shared = parts.unionByName(found.where("copied").select("id", "start_pos", "n")).distinct()

    w = Window.partitionBy("id").orderBy("start_pos")
    last = F.col("start_pos") + F.col("n") - 1
    before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = shared.withColumn("first", before.isNull() | (F.col("start_pos") - before > span)).withColumn("island", F.sum(F.col("first").cast("int")).over(w))
    joined = island.groupBy("id", "island").agg(F.min("start_pos").alias("start_pos"), (F.max(last) + span).alias("end_pos"))
    only = joined.join(members.where("lo < hi").select("id"), "id", "left_anti").select("id", "start_pos", "end_pos")
    out = only.unionByName(whole)
    return out.select(F.col("id").alias(id_col), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"))


def shared_share(df: DataFrame, id_col: str, text_col: str, span: int = 200) -> DataFrame:
    """For every record how much of it is shared: id, n_chars, shared_chars, share (rounded to 6 places).

    Null texts have n_chars null and share null; empty texts have 0, 0 and null.
    """
    spans = shared_spans(df, id_col, text_col, span).groupBy(F.col(id_col).alias("id")).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared"))
    rows = df.select(df[id_col].alias("id"), F.length(df[text_col]).cast("bigint").alias("n_chars")).where("id IS NOT NULL").groupBy("id").agg(F.max("n_chars").alias("n_chars"))
    shared = F.coalesce(F.col("shared"), F.lit(0)).cast("bigint")
    share = F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6))
    return rows.join(spans, "id", "left").select(F.col("id").alias(id_col), "n_chars", shared.alias("shared_chars"), share.alias("share"))
