"""Stages written to the shared folder, so that lost executors cost no recomputation of what came before."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, as in tests, a new temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            return existing.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stages_")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, and each row is computed once.

    The written table is removed by release(), or else when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder within the shared one, removed with the stages."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        # after the session's own exit handlers, so as to run before them
        atexit.unregister(release)
        atexit.register(release)
    _written.append((spark, path))
    return path


_written: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Removes all stages written so far: for long sessions, once their results have been read."""
    while _written:
        _remove(*_written.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    """spark.sql.shuffle.partitions as a number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
