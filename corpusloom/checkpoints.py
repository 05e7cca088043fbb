"""Cutting of long plans, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, or the one that spark.checkpoint.dir names; one of our own only on a single machine where none is set."""
    sc = spark.sparkContext
    if (known := sc.getCheckpointDir()) is not None:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hadoop(spark: SparkSession, path: str):
    """(file system, path on it) as Spark itself sees a path."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there
