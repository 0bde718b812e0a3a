"""Vector matrices as files: for each scope, item and year one or more .npz with `mat` (float32) and `ids`, as tools outside
Spark read them. A large universe is written in parts, so that no task holds more than PART rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.sources.sinks import shared_uri

PART = 65_536


def write_matrices(vectors: DataFrame, root: str, part: int = PART) -> int:
    """Writes firm, year, item_id, vec (of one length) as <root>/<item_id>/<year>/<part>.npz, rows by firm; returns how
    many files. Rows without a vector or key are left out."""
    uri = shared_uri(root)
    rows = vectors.select("firm", "year", "item_id", "vec").where("vec IS NOT NULL AND firm IS NOT NULL AND year IS NOT NULL AND item_id IS NOT NULL")
    sizes = rows.groupBy("item_id", "year").agg(F.ceil(F.count("*") / part).alias("parts"))
    parts = rows.join(sizes, ["item_id", "year"]).withColumn("part", F.pmod(F.xxhash64("firm"), F.col("parts")).cast("int"))

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("firm")
        item, year, number = (table.column(c)[0].as_py() for c in ("item_id", "year", "part"))
        mat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(table.num_rows, -1)
        sink = io.BytesIO()
        np.savez(sink, mat=mat, ids=np.asarray(table.column("firm").to_pylist(), dtype=str))
        fs, folder = pafs.FileSystem.from_uri(uri)
        folder = f"{folder.rstrip('/')}/{item}/{year}"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{number}.npz") as f:
            f.write(sink.getvalue())
        return pa.table({"n": [1]})

    return parts.groupBy("item_id", "year", "part").applyInArrow(write, "n BIGINT").agg(F.sum("n")).first()[0] or 0


def read_matrices(spark: SparkSession, root: str) -> DataFrame:
    """firm, year, item_id, vec of all matrix files below root. A file whose ids and rows differ in number is refused."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.load(io.BytesIO(content)) as z:
                    mat, ids = z["mat"], z["ids"]
                if mat.ndim != 2 or len(mat) != len(ids):
                    raise ValueError(f"{path}: {len(ids)} ids for a matrix of shape {mat.shape}")
                item, year = path.split("/")[-3:-1]
                for a in range(0, len(ids), 4096):
                    m = np.ascontiguousarray(mat[a : a + 4096], dtype=np.float32)
                    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
                    columns = [pa.array(ids[a : a + 4096].tolist(), pa.string()), pa.array(np.full(len(m), int(year), np.int32)), pa.array([item] * len(m)), pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, ["firm", "year", "item_id", "vec"])

    return found.mapInArrow(rows, "firm STRING, year INT, item_id STRING, vec ARRAY<FLOAT>")
