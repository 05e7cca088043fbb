"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions: what its owner holds right for one task's memory."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_bits(spark: SparkSession, least: int = 8) -> int:
    """How many top bits of a hash deal rows out: 256 buckets, and more where the session has more partitions, so that a bucket stays as small."""
    return max(least, (partitions(spark) - 1).bit_length())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or the one it names; one of our own only where none is set on a single machine, as in tests."""
    sc = spark.sparkContext
    if (known := sc.getCheckpointDir()) is not None:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the columns of their class, from `classes` (key, n: its rows, ...).

    With p shuffle partitions at most 4 p classes hold over 1/(4 p) of `total` rows each: these are broadcast.
    No other class is large enough to crowd a task, so they are joined by key.
    """
    p = 4 * partitions(rows.sparkSession)
    hot, rest = classes.where(F.col("n") * p > total), classes.where(F.col("n") * p <= total)
    of_hot = rows.join(F.broadcast(hot.drop("n")), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.drop("n"), key)
    return of_hot.unionByName(others)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or it with underscores behind, which no column of `df` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as SQL takes it, dots and all."""
    return "`" + name.replace("`", "``") + "`"
