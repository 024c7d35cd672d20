"""Staged tables: how the corpus operators cut lineage.

A stage is written as Parquet below the folder in ``spark.checkpoint.dir`` (which
a cluster shares between all executors) and read back, so a lost executor costs
a re-read and not a recomputation.  Where that setting is absent a local master, as in
tests, gets a temporary folder for the session; on a cluster that is an error.  A table that no
operator has discarded before goes when the driver's JVM ends.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables; only where none is configured a local one is chosen."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="eventloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/eventloom-{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """SQL settings, by name with __ for dots, for what is planned and run inside."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffle_files_freed(spark: SparkSession):
    """Shuffle files of a write are of no use once the table stands."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def drop_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which exists and is deleted when the driver's JVM ends."""
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that reads it back."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with shuffle_files_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    drop_at_exit(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._eventloom_path = path
    return back


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_eventloom_path", None)
        if path:
            spark = table.sparkSession
            _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
