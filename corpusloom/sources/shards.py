"""Numbered shards of JSON lines, each full but the last, written by a data source with commit messages."""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..checkpoints import checkpointed, hadoop
from ..operators.budget import assign_shards
from .archives import file_system


@dataclass
class Written(WriterCommitMessage):
    """The finished files of a task."""

    files: list[str]


class JsonShards(DataSource):
    """`df.write.format("jsonshards").mode("append").save(folder)`: rows (shard, name, record: JSON text), sorted by shard, as one gzip file for each name.

    A task writes to a folder of its own. Only when all tasks are done are their files moved to their
    names; a failed job's folder is removed, and so is what failed or repeated tries of tasks have left.
    The folder is on a file system that Arrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonshards"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ShardWriter({k.lower(): v for k, v in dict(self.options).items()}["path"])


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = file_system(self.path)
        own = f"{top}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        files, raw, out, open_ = [], None, None, None
        for batch in iterator:
            for name, record in zip(batch.column("name").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if name != open_:
                    if out is not None:
                        out.close()
                        raw.close()
                    open_ = name
                    files.append(f"{own}/{name}")
                    raw = system.open_output_stream(files[-1], compression=None)
                    out = gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0)
                out.write(record.encode() + b"\n")
        if out is not None:
            out.close()
            raw.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, top = file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        there = {i.path.rsplit("/", 1)[-1] for i in system.get_file_info(fs.FileSelector(top))}
        names = [f.rsplit("/", 1)[-1] for f in files]
        if there & set(names) or len(set(names)) < len(names):
            self.abort(messages)
            raise FileExistsError(f"shards are there already: {sorted(there & set(names))[:3]}")
        for f, name in zip(files, names, strict=True):
            system.move(f, f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, top = file_system(self.path)
        if system.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.job}")


def next_number(spark: SparkSession, path: str, prefix: str = "korpus_") -> int:
    """One past the greatest number of the shards at `path`, 1 where there is none."""
    system, top = hadoop(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(top)] if system.exists(top) else []
    found = (re.fullmatch(re.escape(prefix) + r"(\d+)\.jsonl\.gz", n) for n in names)
    return max((int(m[1]) for m in found if m), default=0) + 1


def write_shards(df: DataFrame, path: str, order: str, bucket: Column, per_shard: int = 20_000, prefix: str = "korpus_") -> int:
    """`df`, in order, as `korpus_0001.jsonl.gz` and on: `per_shard` records each, but for the last. Numbers go on behind those that are there. Returns how many shards were written.

    Numbers come from running counts in two levels (`assign_shards`), so shards are full whatever the
    tasks; each is one task's. `order` is unique, `bucket` an order-preserving bucket of it.
    """
    spark = df.sparkSession
    spark.dataSource.register(JsonShards)
    first = next_number(spark, path, prefix) - 1
    placed = assign_shards(df.select(F.col(order).alias("_order"), bucket.alias("_bucket")), "_order", F.col("_bucket"), per_shard)
    numbers = checkpointed(placed.select("_order", (F.col("shard") + first).alias("_shard")))
    shards = (numbers.agg(F.max("_shard")).first()[0] or first) - first
    if not shards:
        return 0
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    rows = df.select(F.col(order).alias("_order"), record.alias("record")).join(numbers, "_order")
    rows = rows.repartition(shards, "_shard").sortWithinPartitions("_shard", "_order")
    name = F.concat(F.lit(prefix), F.lpad(F.col("_shard").cast("string"), 4, "0"), F.lit(".jsonl.gz"))
    named = F.when(F.col("_shard") < 10_000, name).otherwise(F.concat(F.lit(prefix), F.col("_shard").cast("string"), F.lit(".jsonl.gz")))
    rows.select(F.col("_shard").alias("shard"), named.alias("name"), "record").write.format("jsonshards").mode("append").save(path)
    return shards


def read_shards(spark: SparkSession, path: str, schema: str, prefix: str = "korpus_") -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", f"{prefix}*.jsonl.gz").json(path)
