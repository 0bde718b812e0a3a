"""Weak labels and measures of peer rankings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from peerlens.functions import text as X
from peerlens.plans import shuffle_partitions

CODES, BANDS = ("sic", "naics", "gics"), ("market_cap", "revenue")
#: Pairs that are compared at once, and labels in a batch.
BLOCK, ROWS = 1_000_000, 131_072


def band_match(a: Column, b: Column, ratio: float = 2.0) -> Column:
    """True if both are positive numbers and neither is more than `ratio` times the other; false for null and NaN."""
    good = (a > 0) & (b > 0) & ~F.isnan(a) & ~F.isnan(b)
    return F.coalesce(good & (F.greatest(a, b) / F.least(a, b) <= ratio), F.lit(False))


def _first(codes: list[str], bands: list[str]) -> WindowSpec:
    return Window.partitionBy("firm", "year").orderBy(*(F.col(c).asc_nulls_last() for c in (*codes, *bands)))


def _numbers(table: pa.Table, c: str) -> np.ndarray:
    """Sizes; NaN where there is no finite positive number."""
    x = table.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.where((x > 0) & (x < np.inf), x, np.nan)


def _metadata_rows(metadata: DataFrame, focal: Column | None) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Distinct rows of the firms and years (firm, year, codes, bands), the one that counts of each focal firm and year,
    and the codes and bands there are."""
    codes, bands = [c for c in CODES if c in metadata.columns], [c for c in BANDS if c in metadata.columns]
    rows = metadata.select(X.cik(F.col("firm_id")).alias("firm"), F.col("year").cast("int").alias("year"), *(F.col(c).cast("string").alias(c) for c in codes), *(F.col(c).cast("double").alias(c) for c in bands))
    rows = rows.where("firm IS NOT NULL AND year IS NOT NULL").distinct()
    asked = rows.where(focal if focal is not None else F.lit(True)).withColumn("_n", F.row_number().over(_first(codes, bands))).where("_n = 1").drop("_n")
    return rows, asked, codes, bands


def _matches(codes: list[str], bands: list[str], ratio: float):
    """A function of the peers' rows of one year that returns their firms and, for rows of focal firms, a matrix: which
    of these are labels of which."""

    def prepare(peers: pa.Table):
        # a firm with one row has one column of the matrix, the columns of others are joined
        peers = peers.combine_chunks()
        firm = peers.column("firm").combine_chunks().dictionary_encode()
        at = firm.indices.to_numpy()
        count = np.bincount(at, minlength=len(firm.dictionary))
        order = np.lexsort((at, count[at] > 1))
        peers, of = peers.take(pa.array(order)), at[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        firms, single = firm.dictionary.take(pa.array(of[starts])), int((count == 1).sum())
        values = {c: peers.column(c).combine_chunks().dictionary_encode() for c in codes}
        known = {c: v.indices.fill_null(-2).to_numpy() for c, v in values.items()}
        sizes = {c: _numbers(peers, c) for c in bands}

        def matrix(mine: pa.Table) -> np.ndarray:
            found = np.zeros((len(mine), len(of)), dtype=bool)
            for c in codes:
                index = pc.index_in(mine.column(c), values[c].dictionary, skip_nulls=True).fill_null(-1).to_numpy()
                found |= index[:, None] == known[c]
            with np.errstate(invalid="ignore", over="ignore"):
                for c in bands:
                    x = _numbers(mine, c)[:, None]
                    found |= np.maximum(x, sizes[c]) / np.minimum(x, sizes[c]) <= ratio
            if single < len(of):
                found = np.concatenate([found[:, :single], np.logical_or.reduceat(found[:, single:], starts[single:] - single, axis=1)], axis=1)
            own = pc.index_in(mine.column("firm"), firms)
            there = np.flatnonzero(np.asarray(own.is_valid()))
            found[there, own.drop_null().to_numpy()] = False
            return found

        return firms, matrix

    return prepare


def _compared(metadata: DataFrame, focal: Column | None, ratio: float, emit, schema: str) -> DataFrame:
    """What emit makes of the focal firms' names, the peers' and the matrix of labels, for each year and part of peers.

    Every pair of a year is compared, but nothing of a pair is shuffled: the peers are dealt to the tasks by firm, each
    task gets all focal firms, and compares them with its peers of the year block by block.
    """
    rows, asked, codes, bands = _metadata_rows(metadata, focal)
    n = shuffle_partitions(metadata.sparkSession)
    fields = ("firm", "year", *codes, *bands)
    peers = rows.select(*fields, F.lit(False).alias("asks"), F.pmod(F.xxhash64("firm"), F.lit(n)).cast("int").alias("part"))
    mine = asked.select(*fields, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    prepare = _matches(codes, bands, ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        year = ready = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = np.stack([table.column("year").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), len(table)]
            for s, e in zip(cuts, cuts[1:]):
                some = table.slice(s, e - s)
                if key[0, s] != year:
                    held, year, ready = [], key[0, s], None
                if not key[1, s]:
                    held.append(some)
                    continue
                if not held:
                    continue
                firms, matrix = ready = ready or prepare(pa.concat_tables(held))
                step = max(1, BLOCK // len(firms))
                for at in range(0, len(some), step):
                    block = some.slice(at, step)
                    yield from emit(block.column("firm").combine_chunks(), pa.scalar(year, pa.int32()), firms, matrix(block))

    return peers.unionByName(mine).repartitionById(n, "part").sortWithinPartitions("year", "asks", "firm").drop("part").mapInArrow(run, schema)


def weak_labels(metadata: DataFrame, focal: Column | None = None, ratio: float = 2.0) -> DataFrame:
    """focal_firm, year, peer_firm (distinct): firms of the same year that share a code with the focal firm or lie in
    its size bands. Columns that the table lacks are skipped. The focal firm's values are those of its first row, in
    the order of all its values, nulls last; of a peer any row counts.

    The labels are a share of all pairs, so they leave the tasks that find them without another shuffle.
    """

    def emit(mine: pa.Array, year: pa.Scalar, firms: pa.Array, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        f, p = (x.astype(np.int32) for x in np.nonzero(found))
        for s in range(0, len(f), ROWS):
            some = slice(s, s + ROWS)
            yield pa.record_batch([mine.take(pa.array(f[some])), pa.repeat(year, len(f[some])), firms.take(pa.array(p[some]))], ["focal_firm", "year", "peer_firm"])

    return _compared(metadata, focal, ratio, emit, "focal_firm STRING, year INT, peer_firm STRING")


def _within(order: np.ndarray, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each question, how many of order[lo:hi] are at least low and less than high; order: a permutation of 0..n-1.

    Bit by bit from the highest, zeros before ones (a wavelet matrix), but each level is dropped once all questions have
    passed it.
    """
    n, found = len(order), np.zeros(len(lo), dtype=np.int64)
    bits = max(1, int(n).bit_length())
    for sign, bound in ((1, high), (-1, low)):
        at, s, e = order, lo, hi
        for b in range(bits - 1, -1, -1):
            one = (at >> b) & 1
            zeros = np.r_[0, np.cumsum(1 - one)]
            z, up = zeros[-1], ((bound >> b) & 1).astype(bool)
            s0, e0 = zeros[s], zeros[e]
            found += sign * np.where(up, e0 - s0, 0)
            s, e = np.where(up, z + s - s0, s0), np.where(up, z + e - e0, e0)
            at = np.concatenate([at[one == 0], at[one == 1]])
    return found


def _counts(codes: list[str], bands: list[str], ratio: float):
    """A function of the peers' rows and focal firms' rows of one year that returns how many firms are labels of each.

    Of firms with one row nothing is compared in pairs: a band is a stretch of the rows in order of the number, a code a
    stretch of the rows in order of the code, and what two bands, a code and two bands and so on share is counted in
    rectangles. Only firms with several rows are compared one by one.
    """
    prepare = _matches(codes, bands, ratio)

    def stretch(sizes: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the numbers (sorted, none NaN) in the band of mine; the same division decides as elsewhere."""
        n = len(sizes)
        sizes, starts = np.unique(sizes, return_index=True)
        starts = np.r_[starts, n]
        last, there = len(sizes) - 1, ~np.isnan(mine)
        if last < 0:
            return np.zeros(len(mine), dtype=np.int64), np.zeros(len(mine), dtype=np.int64)

        def alike(at: np.ndarray) -> np.ndarray:
            x = sizes[np.clip(at, 0, last)]
            return there & (np.maximum(mine, x) / np.minimum(mine, x) <= ratio)

        with np.errstate(invalid="ignore", over="ignore"):
            s, e = np.searchsorted(sizes, mine / ratio, "left"), np.searchsorted(sizes, mine * ratio, "right")
            # rounding may leave a bound some numbers off
            while (off := (s > 0) & alike(s - 1)).any():
                s = s - off
            while (off := there & (s < e) & ~alike(s)).any():
                s = s + off
            while (off := (e <= last) & alike(e)).any():
                e = e + off
            while (off := there & (s < e) & ~alike(e - 1)).any():
                e = e - off
        return np.where(there, starts[s], 0), np.where(there, starts[e], 0)

    def count(peers: pa.Table, mine: pa.Table) -> np.ndarray:
        firm = peers.column("firm").combine_chunks().dictionary_encode()
        often = np.bincount(firm.indices.to_numpy(), minlength=len(firm.dictionary))[firm.indices.to_numpy()] > 1
        several, peers = peers.filter(pa.array(often)), peers.filter(pa.array(~often))
        n, asked = len(peers), len(mine)
        total = np.zeros(asked, dtype=np.int64)
        if len(several):
            firms, matrix = prepare(several)
            step = max(1, BLOCK // len(firms))
            for at in range(0, asked, step):
                total[at : at + step] += np.count_nonzero(matrix(mine.slice(at, step)), axis=1)
        # ranks by each band, numbers first; the band of a focal firm is a stretch of ranks
        ranks, bounds = [], []
        for c in bands:
            x = _numbers(peers, c)
            order = np.argsort(x, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.arange(n)
            ranks.append(rank)
            bounds.append(stretch(x[order[: np.count_nonzero(~np.isnan(x))]], _numbers(mine, c)))
        known, own = [], []
        for c in codes:
            values = peers.column(c).combine_chunks().dictionary_encode()
            known.append(values.indices.fill_null(-1).to_numpy().astype(np.int64))
            own.append(pc.index_in(mine.column(c), values.dictionary, skip_nulls=True).fill_null(-2).to_numpy().astype(np.int64))

        for size in range(len(codes) + 1):
            for some in combinations(range(len(codes)), size):
                # rows that share all of these codes, as one group of rows: a key of the rows, or -1
                key, ask = np.zeros(n, dtype=np.int64), np.zeros(asked, dtype=np.int64)
                for i in some:
                    good, well = (key >= 0) & (known[i] >= 0), (ask >= 0) & (own[i] >= 0)
                    span = int(known[i].max(initial=0)) + 1
                    key, ask = np.where(good, key * span + known[i], -1), np.where(well, ask * span + own[i], -1)
                    # small keys again, so that they don't grow beyond 64 bits
                    u, key = np.unique(np.r_[-1, key], return_inverse=True)
                    key = key[1:] - 1
                    at = np.minimum(np.searchsorted(u, ask), len(u) - 1)
                    ask = np.where((ask >= 0) & (u[at] == ask), at - 1, -1)
                asks = np.flatnonzero(ask >= 0)
                a = ask[asks]

                def group(by: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    """Rows by key and rank, and for each question its rows of the key (in its band) among these."""
                    lo, hi = (np.zeros(len(a), dtype=np.int64), np.full(len(a), n)) if by is None else (bounds[by][0][asks], bounds[by][1][asks])
                    sort = key * (n + 1) + (ranks[by] if by is not None else 0)
                    order = np.argsort(sort, kind="stable")
                    return order, *(np.searchsorted(sort[order], a * (n + 1) + x) for x in (lo, hi))

                shares = 0
                for take in range(len(bands) + 1):
                    for inside in combinations(range(len(bands)), take):
                        if not some and not inside:
                            continue
                        order, s, e = group(inside[0] if inside else None)
                        if len(inside) < 2:
                            among = e - s
                        else:
                            b = inside[1]
                            among = _within(ranks[b][order], s, e, bounds[b][0][asks], bounds[b][1][asks])
                        shares = shares + (-1) ** take * among
                total[asks] += (-1) ** (size + 1) * shares
        if n:
            # a focal firm with one row is alike to itself if it has a code or a number
            alone = np.asarray(pc.is_in(mine.column("firm"), peers.column("firm").combine_chunks()))
            full = np.zeros(asked, dtype=bool)
            for c in codes:
                full |= np.asarray(mine.column(c).is_valid())
            for c in bands:
                full |= ~np.isnan(_numbers(mine, c))
            total -= alone & full
        return total

    return count


def label_counts(metadata: DataFrame, focal: Column | None = None, ratio: float = 2.0) -> DataFrame:
    """focal_firm, year, label_count: how many weak_labels there are, without writing them out or comparing all pairs. The
    rows of a year are counted in one task."""
    rows, _, codes, bands = _metadata_rows(metadata, None)
    asks = (F.row_number().over(_first(codes, bands)) == 1) & F.coalesce(focal if focal is not None else F.lit(True), F.lit(False))
    rows = rows.withColumn("asks", asks)
    count = _counts(codes, bands, ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for year, peers in _years(batches):
            mine = peers.filter(peers.column("asks"))
            if len(mine):
                yield pa.record_batch([mine.column("firm").combine_chunks(), pa.repeat(year, len(mine)), pa.array(count(peers, mine), pa.int64())], ["focal_firm", "year", "label_count"])

    return rows.repartition("year").sortWithinPartitions("year").mapInArrow(run, "focal_firm STRING, year INT, label_count BIGINT").where("label_count > 0")


def _years(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, pa.Table]]:
    """The rows of each year, from batches in order of year."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        key = table.column("year").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(table)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if held and held[-1].column("year")[0].as_py() != key[s]:
                yield held[0].column("year")[0], pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(s, e - s))
    if held:
        yield held[0].column("year")[0], pa.concat_tables(held).combine_chunks()


def judged(pairs: DataFrame, metadata: DataFrame, focal: Column | None = None, ratio: float = 2.0) -> DataFrame:
    """pairs (focal_firm, year, peer_firm, ...) with label: whether the pair is one of weak_labels. Only the firms of the
    pairs are compared."""
    rows, asked, codes, bands = _metadata_rows(metadata, focal)
    own = asked.select(F.col("firm").alias("focal_firm"), "year", F.struct(*codes, *bands, F.lit(True).alias("there")).alias("_own"))
    theirs = rows.groupBy(F.col("firm").alias("peer_firm"), "year").agg(F.collect_list(F.struct(*codes, *bands, F.lit(True).alias("there"))).alias("_theirs"))

    def alike(x: Column) -> Column:
        found = [F.coalesce(x[c] == F.col("_own")[c], F.lit(False)) for c in codes]
        found += [band_match(x[c], F.col("_own")[c], ratio) for c in bands]
        return reduce(lambda a, b: a | b, found, F.lit(False))

    label = F.coalesce((F.col("focal_firm") != F.col("peer_firm")) & F.col("_own").isNotNull() & F.exists("_theirs", alike), F.lit(False))
    return pairs.join(own, ["focal_firm", "year"], "left").join(theirs, ["peer_firm", "year"], "left").select(*pairs.columns, label.alias("label"))


def labels_and_analysts(metadata: DataFrame, analysts: DataFrame, focal: Column | None = None, ratio: float = 2.0) -> DataFrame:
    """with_analysts(weak_labels(...), analysts): of the analysts' pairs those are added that are no labels, so that the
    labels themselves are not shuffled."""
    added = judged(_named(analysts).distinct(), metadata, focal, ratio).where("NOT label").drop("label")
    return weak_labels(metadata, focal, ratio).unionByName(added)


def _named(analysts: DataFrame) -> DataFrame:
    return analysts.select(X.cik(F.col("focal_firm")).alias("focal_firm"), F.col("year").cast("int").alias("year"), X.cik(F.col("peer_firm")).alias("peer_firm"))


def with_analysts(labels: DataFrame, analysts: DataFrame) -> DataFrame:
    """Labels and the peers that analysts name; these may name the focal firm itself."""
    return labels.unionByName(_named(analysts)).distinct()


def metrics(ranking: DataFrame, labels: DataFrame, recall_k: int = 50, ndcg_k: int = 10) -> DataFrame:
    """focal_firm, year, label_count, recall_at_K, ndcg_at_K of every ranked (focal_firm, year); null without labels.

    ranking: focal_firm, year, peer_firm, rank from 1. labels: focal_firm, year, peer_firm, distinct.
    """
    keys = ["focal_firm", "year"]
    most = max(recall_k, ndcg_k)
    near = F.when(F.col("rank") <= most, F.col("peer_firm")), F.when(F.col("rank") <= most, F.col("rank").cast("int"))
    given = ranking.select(*keys, near[0].alias("peer_firm"), near[1].alias("rank"), F.lit(True).alias("ranked"), F.lit(False).alias("label"))
    named = labels.select(*keys, "peer_firm", F.lit(None).cast("int").alias("rank"), F.lit(False).alias("ranked"), F.lit(True).alias("label"))
    # one aggregation by pair, then one by focal firm and year, instead of joins of either table with itself
    pairs = given.unionByName(named).groupBy(*keys, "peer_firm").agg(F.min("rank").alias("rank"), F.bool_or("ranked").alias("ranked"), F.bool_or("label").alias("label"))
    rows = pairs.groupBy(*keys).agg(F.bool_or("ranked").alias("_ranked"), F.count_if("label").alias("label_count"), *_hits(recall_k, ndcg_k)).where("_ranked")
    return _measures(rows, recall_k, ndcg_k)


def metrics_of(ranking: DataFrame, metadata: DataFrame, focal: Column | None = None, recall_k: int = 50, ndcg_k: int = 10) -> DataFrame:
    """metrics(ranking, weak_labels(metadata, focal)), where the labels are counted and the best peers judged, but no
    label is written out. Of each focal firm and year the ranking holds rank 1."""
    keys = ["focal_firm", "year"]
    near = judged(ranking.where(F.col("rank") <= max(recall_k, ndcg_k)).select(*keys, "peer_firm", "rank"), metadata, focal)
    rows = near.groupBy(*keys).agg(*_hits(recall_k, ndcg_k)).join(label_counts(metadata, focal), keys, "left")
    return _measures(rows.withColumn("label_count", F.coalesce("label_count", F.lit(0))), recall_k, ndcg_k)


def _hits(recall_k: int, ndcg_k: int) -> list[Column]:
    """Labels among the best, and their discounted gain."""
    hit = F.col("label") & F.col("rank").isNotNull()
    gain = F.coalesce(F.sum(F.when(hit & (F.col("rank") <= ndcg_k), 1 / F.log2(F.col("rank") + F.lit(1.0)))), F.lit(0.0))
    return [F.count_if(hit & (F.col("rank") <= recall_k)).alias("_h"), gain.alias("_dcg")]


def _measures(rows: DataFrame, recall_k: int, ndcg_k: int) -> DataFrame:
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(ndcg_k), F.col("label_count").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    there = F.col("label_count") > 0
    return rows.select("focal_firm", "year", "label_count", F.when(there, F.round(F.col("_h") / F.col("label_count"), 6)).alias(f"recall_at_{recall_k}"), F.when(there, F.round(F.col("_dcg") / ideal, 6)).alias(f"ndcg_at_{ndcg_k}"))


def summary(measured: DataFrame, recall_k: int = 50, ndcg_k: int = 10) -> DataFrame:
    """One row: rows, labelled (rows with labels) and the mean of each metric over these, rounded to 6 places."""
    mean = lambda c: (F.round(F.avg(c), 6) + 0.0).alias(c)
    return measured.agg(F.count("*").alias("rows"), F.count(f"recall_at_{recall_k}").alias("labelled"), mean(f"recall_at_{recall_k}"), mean(f"ndcg_at_{ndcg_k}"))


def stability(ranking: DataFrame, top_k: int = 10) -> DataFrame:
    """focal_firm, prev_year, year, top_k, jaccard of the best peers of neighbouring observed years (gaps allowed)."""
    tops = ranking.where((F.col("rank") <= top_k) & F.col("year").isNotNull()).groupBy("focal_firm", "year").agg(F.collect_set("peer_firm").alias("_now"))
    w = Window.partitionBy("focal_firm").orderBy("year")
    rows = tops.withColumn("prev_year", F.lag("year").over(w)).withColumn("_then", F.lag("_now").over(w)).where("prev_year IS NOT NULL")
    share = F.size(F.array_intersect("_now", "_then")) / F.size(F.array_union("_now", "_then"))
    return rows.select("focal_firm", "prev_year", "year", F.lit(top_k).alias("top_k"), F.round(share, 6).alias("jaccard"))
