"""Vectors of items: embedding stand-in, pooling, candidates, residuals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.config import Q_SHARE
from peerlens.functions.vectors import dot, norm, unit
from peerlens.plans import stage

#: Firms of a universe that are compared in one group, and cosines computed at once.
PART, BLOCK = 32_768, 4_000_000


class Embedder(Protocol):
    """Texts to unit vectors."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic stand-in for a model: signed counts of hashed words, of unit length."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8], "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)).astype(np.float32)


def embed(df: DataFrame, text: str, model: Embedder, out: str = "embedding") -> DataFrame:
    """Adds the vector of each text; the model is made once for each worker. Null texts have null vectors."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = model([t or "" for t in texts])
            yield pd.Series([None if t is None else v for t, v in zip(texts, found)])

    return df.withColumn(out, vectors(F.col(text)))


class SentenceEmbedder:
    """A sentence-transformers model, loaded once in each worker that uses it; the library must be installed there."""

    def __init__(self, name: str = "BAAI/bge-m3", batch: int = 32):
        self.name, self.batch = name, batch
        self._model = None

    def __getstate__(self) -> dict:
        return {"name": self.name, "batch": self.batch, "_model": None}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name)
        return np.asarray(self._model.encode(texts, batch_size=self.batch, normalize_embeddings=True), dtype=np.float32)


def embedder(name: str, dim: int = 384) -> Embedder:
    """`hash` for the stand-in, anything else names a sentence-transformers model."""
    return HashEmbedder(dim) if name == "hash" else SentenceEmbedder(name)


def item_years(vectors: DataFrame) -> DataFrame:
    """The items and years that have vectors."""
    return vectors.select("item_id", "year").where("item_id IS NOT NULL AND year IS NOT NULL").distinct()


def _components(vec: Column, dim: int, weight: Column | None = None, how=F.avg) -> Column:
    """Element-wise aggregate of a vector column, without exploding it."""
    return F.array(*(how(vec[i].cast("double") * (weight if weight is not None else F.lit(1.0))) for i in range(dim)))


def centroid(df: DataFrame, keys: list[str], vec: str, dim: int) -> DataFrame:
    """keys, num_units, centroid."""
    return df.groupBy(*keys).agg(F.count("*").alias("num_units"), _components(F.col(vec), dim).alias("centroid"))


def percentile_cap(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, _cap: the exact percentile (linear interpolation) of each group, in two steps, so that no task holds a group:
    counts in bins of single-precision size tell in which bin the two middle values lie, and only the values of these bins
    are sorted. Values are positive and finite."""
    bins = rows.select(*keys, F.col(value).alias("_w"), F.col(value).cast("float").alias("_b"))
    counts = bins.groupBy(*keys, F.floor(F.log2("_b") * 64).alias("_bin")).agg(F.count("*").alias("_c"))
    by = Window.partitionBy(*keys)
    counts = counts.withColumn("_to", F.sum("_c").over(by.orderBy("_bin"))).withColumn("_n", F.sum("_c").over(by))
    place = (F.col("_n") - 1) * F.lit(share)
    low, high = F.floor(place), F.ceil(place)
    hit = lambda x: (x < F.col("_to")) & (x >= F.col("_to") - F.col("_c"))
    wanted = counts.where(hit(low) | hit(high)).select(*keys, "_bin", (F.col("_to") - F.col("_c")).alias("_before"), low.alias("_low"), high.alias("_high"), (place - low).alias("_part"))
    inside = bins.withColumn("_bin", F.floor(F.log2("_b") * 64)).join(wanted, [*keys, "_bin"])
    ranked = inside.withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_w")) - 1)
    ends = ranked.where((F.col("_i") == F.col("_low")) | (F.col("_i") == F.col("_high"))).groupBy(*keys).agg(F.min("_w").alias("_l"), F.max("_w").alias("_h"), F.max("_part").alias("_part"))
    return ends.select(*keys, (F.col("_l") * (1 - F.col("_part")) + F.col("_h") * F.col("_part")).alias("_cap"))


def distinctiveness_pool(df: DataFrame, keys: list[str], vec: str, dim: int, percentile: float = 0.95, eps: float = 1e-6) -> DataFrame:
    """keys, num_units, pooled, w_max, w_mean: the vectors of each group, weighted by their distance from the centroid
    plus eps, where weights above the percentile (linear interpolation) are cut to it; of unit length. A single vector
    has weight 1. Only built-in aggregates, with partial sums before each shuffle; the weighed vectors are staged, so that
    df is read once for the centroids and once for the weights. Groups with a null in a key are left out."""
    rows = df.select(*keys, F.col(vec).alias("_v"))
    mean = centroid(rows, keys, "_v", dim)
    distance = F.when(F.col("num_units") == 1, 1.0).otherwise(norm(F.zip_with("_v", "centroid", lambda x, c: x.cast("double") - c)) + eps)
    weighed = stage(rows.join(mean, keys).select(*keys, "_v", distance.alias("_w")), "weighed")
    w = F.least("_w", "_cap")
    capped = weighed.join(percentile_cap(weighed, keys, "_w", percentile), keys).select(*keys, "_v", w.alias("_w"))
    sums = capped.groupBy(*keys).agg(F.count("*").alias("num_units"), _components(F.col("_v"), dim, F.col("_w"), F.sum).alias("_s"), F.sum("_w").alias("_t"), F.max("_w").alias("w_max"), F.avg("_w").alias("w_mean"))
    return sums.select(*keys, "num_units", unit(F.transform("_s", lambda x: x / (F.col("_t") + 1e-12))).alias("pooled"), "w_max", "w_mean")


def pool(vectors: np.ndarray, percentile: float = 95.0, eps: float = 1e-6) -> tuple[np.ndarray, float, float]:
    """distinctiveness_pool of one group in numpy: pooled vector, w_max, w_mean."""
    v = np.asarray(vectors, dtype=np.float64)
    w = np.ones(1) if len(v) == 1 else np.sqrt(((v - v.mean(axis=0)) ** 2).sum(axis=1)) + eps
    w = np.minimum(w, np.percentile(w, percentile))
    mixed = w @ v / (w.sum() + 1e-12)
    return mixed / (np.linalg.norm(mixed) + 1e-12), float(w.max()), float(w.mean())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of unit length."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / (np.sqrt((x * x).sum(axis=1)) + 1e-12)[:, None]


def _scores(q_share: float | None, k: int | None, part: int, residual: bool):
    """The best of the peers of one part of a universe for each focal firm in it, by blocks of matrix products."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("firm", "ascending")]))
        here, asked = table.column("own").to_numpy() == table.column("part")[0].as_py(), np.flatnonzero(table.column("asked").to_numpy(zero_copy_only=False))
        there, n = np.flatnonzero(here), table.column("universe_n")[0].as_py()
        vec, cut = _matrix(table.column("vec")), min(len(there), k + 1 if k is not None else candidate_cut(n, q_share))
        rest = known = None
        if residual:
            known = np.asarray(table.column("residual").is_valid())
            rest = np.zeros_like(vec)
            if known.any():
                rest[known] = _matrix(table.filter(pa.array(known)).column("residual"))
        out = []
        for s in range(0, len(asked), step := max(1, BLOCK // max(1, len(there)))):
            mine = asked[s : s + step]
            cosine = np.round(vec[mine] @ vec[there].T, 6) + 0.0
            if cut < len(there) // 4:
                # the best and all their ties, which the order of firms then settles
                edge = np.partition(cosine, len(there) - cut, axis=1)[:, len(there) - cut]
                f, p = np.nonzero(cosine >= edge[:, None])
            else:
                f, p = np.divmod(np.arange(cosine.size), len(there))
            order = np.lexsort((p, -cosine[f, p], f))
            f, p = f[order], p[order]
            first = np.searchsorted(f, f)
            top = np.arange(len(f)) - first < cut
            f, p = f[top], p[top]
            score = cosine[f, p]
            f, p = mine[f], there[p]
            columns = [table.column("firm").take(pa.array(f)), table.column("firm").take(pa.array(p)), pa.array(score)]
            if residual:
                both = known[f] & known[p]
                columns += [pa.array(np.where(both, np.round((rest[f] * rest[p]).sum(axis=1), 6) + 0.0, score)), pa.array(both)]
            out.append(pa.table(columns, ["focal_firm", "peer_firm", "cosine_score", "sim_specific", "both"][: len(columns)]))
        found = pa.concat_tables(out) if out else None
        if found is None:
            return _empty(table, residual)
        for name in ("year", "item_id", "universe_n"):
            found = found.append_column(name, pa.repeat(table.column(name)[0], found.num_rows))
        return found

    def _empty(table: pa.Table, residual: bool) -> pa.Table:
        kinds = [("focal_firm", table.schema.field("firm").type), ("peer_firm", table.schema.field("firm").type), ("cosine_score", pa.float64()), *([("sim_specific", pa.float64()), ("both", pa.bool_())] if residual else []), *((n, table.schema.field(n).type) for n in ("year", "item_id", "universe_n"))]
        return pa.schema(kinds).empty_table()

    return run


def _best(vectors: DataFrame, focal: Column, q_share: float | None, k: int | None, part: int, residual: DataFrame | None = None) -> DataFrame:
    rows = vectors.where("vec IS NOT NULL").select("firm", "year", "item_id", "vec", F.coalesce(focal, F.lit(False)).alias("asked"))
    sizes = rows.groupBy("item_id", "year").agg(F.count("*").alias("universe_n"))
    if residual is not None:
        rows = rows.join(residual, ["firm", "year", "item_id"])
    parts = F.ceil(F.col("universe_n") / part).cast("int")
    rows = rows.join(sizes, ["item_id", "year"]).withColumn("own", F.pmod(F.xxhash64("firm"), parts).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own"))))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    extra = "sim_specific DOUBLE, both BOOLEAN, " if residual is not None else ""
    schema = f"focal_firm {kind['firm']}, peer_firm {kind['firm']}, cosine_score DOUBLE, {extra}year {kind['year']}, item_id {kind['item_id']}, universe_n BIGINT"
    found = rows.groupBy("item_id", "year", "part").applyInArrow(_scores(q_share, k, part, residual is not None), schema)
    if k is not None:
        found = found.where("focal_firm <> peer_firm")
    cut = F.lit(k) if k is not None else F.least(F.col("universe_n"), F.greatest(F.lit(2), F.ceil(F.col("universe_n") * q_share) + 1))
    w = Window.partitionBy("item_id", "year", "focal_firm").orderBy(F.desc("cosine_score"), "peer_firm")
    return found.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= cut) & (F.col("focal_firm") != F.col("peer_firm"))).drop("_r")


def candidates(vectors: DataFrame, focal: Column, q_share: float | None = Q_SHARE, k: int | None = None, part: int = PART) -> DataFrame:
    """For every focal firm the most similar firms of the same item and year: focal_firm, year, item_id, peer_firm,
    cosine_score (rounded to 6 places), universe_n.

    vectors: firm, year, item_id, vec; one row for each firm, year and item, all of one length; rows without a vector
    take no part. Of the n firms of an item and year, min(n, max(2, ceil(n * q_share) + 1)) are retrieved, the focal firm
    among them, ties by ascending firm; then the focal firm is dropped. With k instead, the k best others. A universe of
    more than `part` firms is split into parts, each a group of its own that all its focal firms go to; a group is compared
    by matrix products, and only the best of each part leave it.
    """
    found = _best(vectors, focal, q_share, k, part)
    return found.select("focal_firm", "year", "item_id", "peer_firm", "cosine_score", "universe_n")


def candidate_cut(n: int, q_share: float = Q_SHARE) -> int:
    return min(n, max(2, math.ceil(n * q_share) + 1))


def orthogonal_residuals(vectors: DataFrame, dim: int, floor: float = 0.10) -> DataFrame:
    """Splits each vector into what it shares with the others of its item and year and the rest: firm, year, item_id,
    common_loading, residual_norm, residual (of unit length; null if shorter than `floor` or if there is no other)."""
    units_ = vectors.select("firm", "year", "item_id", unit(F.col("vec")).alias("_u"))
    sums = units_.groupBy("item_id", "year").agg(F.count("*").alias("_n"), _components(F.col("_u"), dim, how=F.sum).alias("_s"))
    rows = units_.join(sums, ["item_id", "year"])
    rows = rows.withColumn("_c", F.when(F.col("_n") > 1, unit(F.zip_with("_s", "_u", lambda s, u: (s - u) / (F.col("_n") - 1)))))
    rows = rows.withColumn("common_loading", dot(F.col("_u"), F.col("_c")))
    rows = rows.withColumn("_r", F.zip_with("_u", "_c", lambda u, c: u - F.col("common_loading") * c)).withColumn("residual_norm", norm(F.col("_r")))
    return rows.select("firm", "year", "item_id", "common_loading", "residual_norm", F.when(F.col("residual_norm") >= floor, unit(F.col("_r"))).alias("residual"))


def orthogonal_candidates(vectors: DataFrame, dim: int, focal: Column, q_share: float = 0.20, k: int = 20, floor: float = 0.10, part: int = PART) -> DataFrame:
    """The k best peers by what is specific to them: focal_firm, year, item_id, peer_firm, sim_common, sim_specific,
    source, rank.

    Candidates are screened by plain cosine (sim_common), then ranked by the cosine of their residuals; where either
    residual is missing, the plain cosine stands in and source says `pooled` instead of `residual`. Both are computed in
    one pass over each part of a universe.
    """
    rest = orthogonal_residuals(vectors, dim, floor).select("firm", "year", "item_id", "residual")
    both = _best(vectors, focal, q_share, None, part, rest)
    w = Window.partitionBy("item_id", "year", "focal_firm").orderBy(F.desc("sim_specific"), "peer_firm")
    ranked = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    source = F.when(F.col("both"), "residual").otherwise("pooled")
    return ranked.select("focal_firm", "year", "item_id", "peer_firm", F.col("cosine_score").alias("sim_common"), "sim_specific", source.alias("source"), "rank")
