"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Stands in for spark.checkpoint.dir where a local session names none.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_DIR


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/caseweave/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote with scratch(). Call it when no DataFrame built on it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting by which an execution deletes its shuffle files as it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession, tidy: bool = True) -> Iterator[None]:
    """Within, with ``tidy``, the shuffle files of a write go as it ends."""
    before = spark.conf.get(TIDY, "false")
    try:
        spark.conf.set(TIDY, str(tidy or before == "true").lower())
        yield
    finally:
        spark.conf.set(TIDY, before)


def scratch(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends at files every executor can read.

    With ``tidy`` the shuffle files of the write go as it ends: what follows reads the table, so nothing asks for them.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with tidied(spark, tidy):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that scratch() returned as ``df``. Call it when no DataFrame built on it is needed any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == spark.sparkContext.applicationId:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
