"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Only a local session may lack one: it gets a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def persisted(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written_table(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder and read again, for plans that are run after this call. It goes with the folder."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nobody holds any more: it does so when the driver's JVM collects, which may be much later."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table into the shared folder and reads it; the tables go at the end.

    For loops: a checkpoint keeps the size that the planner had estimated, and joins multiply estimates, so that from round to
    round they outgrow all memory. A table that is read has the size of its files.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield written
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
