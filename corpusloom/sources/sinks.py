"""Sinks for corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import hadoop

#: Fixed value: the mark between documents in plain text files.
DOCUMENT_END = "<|belgesonu|>"


def write_sharded(df: DataFrame, path: str, per_shard: int = 20_000, append: bool = False) -> None:
    """gzip JSON lines, at most `per_shard` records a file; `append` adds files to those there."""
    df.write.mode("append" if append else "error").option("maxRecordsPerFile", per_shard).option("compression", "gzip").json(path)


def write_delimited_text(df: DataFrame, path: str, text_col: str = "text", mark: str = DOCUMENT_END) -> None:
    df.select(text_col).write.text(path, lineSep=f"\n\n{mark}\n\n")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder for each value, so that readers of one skip the others."""
    df.write.partitionBy(by).json(path)


def write_roadmap(pivot: DataFrame, path: str, domain: str, counts: list[str]) -> None:
    """A Markdown list of domains with their counts: a small report, so one file."""
    line = F.concat(F.lit("- **"), F.col(domain), F.lit("**: "), F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in counts]))
    pivot.orderBy(domain).select(line).coalesce(1).write.text(path)


def write_token_ids(df: DataFrame, path: str, ids_col: str = "ids") -> None:
    """Token ids as little-endian 16-bit numbers, packed in a binary column: a row's ids are `np.frombuffer(ids, "<u2")`. Ids above 65535 raise."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(x or [], "<u2").tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array([len(x) // 2 for x in raw], pa.int32())], names=["ids", "n"])

    df.select(ids_col).mapInArrow(packed, "ids binary, n int").write.parquet(path)


def write_files(df: DataFrame, path: str, files: int, key: str) -> None:
    """Rows as exactly `files` Parquet files, dealt out by a hash of `key`; empty ones make up the number where rows are few."""
    df.repartition(files, key).write.parquet(path)
    system, top = hadoop(df.sparkSession, path)
    there = sum(f.getPath().getName().startswith("part-") for f in system.listStatus(top))
    for _ in range(files - there):
        df.limit(0).coalesce(1).write.mode("append").parquet(path)
