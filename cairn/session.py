"""Session-level helpers: table loading, the shared work folder, written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame (one parquet file or folder of parts per table)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session runs on this
    machine alone (tests, a laptop) a temporary folder is made and set; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not jsc.isLocal():
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="cairn-")
    spark.sparkContext.setCheckpointDir(own)
    return jsc.getCheckpointDir().get()


#: Paths of the scopes under way, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables made within it at its end: results must be written or collected before.

    Outside of any scope they are removed when the driver ends. A long session that runs many queries puts each in a scope.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_path(spark, path)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared work folder, removed at the end of the scope or of the driver."""
    path = f"{work_root(spark).rstrip('/')}/cairn/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table; does nothing if the session is gone already."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the JVM may have ended before
        pass


def materialise(spark: SparkSession, df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = fresh_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def micros(column) -> "F.Column":
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(column)


def spread(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """df over as many partitions as there are cores, if a few files gave it fewer; for steps that compute much a byte."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
