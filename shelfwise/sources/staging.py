"""Intermediate tables that several branches of one plan read."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or else ``SparkContext.setCheckpointDir`` names.

    A temporary folder of this machine, removed at exit, is used only under a ``local`` master, where driver and executors
    are one process. Any other master without a named folder is an error: each node would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_folder()
    raise RuntimeError(f"master {master!r} needs a shared folder for staged tables: set spark.checkpoint.dir or SparkContext.setCheckpointDir")


def new_path(spark: SparkSession, kind: str = "stage") -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no plan reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame) -> DataFrame:
    """Write once, read many: a Parquet table in the shared folder.

    It outlives executors, cuts the lineage, prunes columns for every reader and gives the planner a
    measured size to decide broadcasts on.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
