"""One stream of all documents' token ids, addressed by position, and windows that run over their borders.

The stream is cut into stretches of `width` ids. A document's place is the sum of the lengths before it,
taken in two levels; its ids go to the one or more stretches that they fall into. A window asks for the
stretches that it covers by their numbers, an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .budget import running_before


def _slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about `most` bytes, one row at least: a batch is cut by rows, and a row here is a whole stretch."""
    for batch in batches:
        step = max(1, most * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def token_stream(df: DataFrame, ids: Column, order: str, bucket: Column, width: int = 1 << 16) -> DataFrame:
    """(stretch, n, ids) of all rows' ids in order; every stretch but the last holds `width` ids. Rows without ids add nothing.

    `order` is unique; `bucket` is an order-preserving bucket of it (`range_bucket`).
    """
    rows = df.select(F.col(order).alias("_order"), bucket.alias("_bucket"), ids.alias("_ids")).where(F.size("_ids") > 0)
    lengths = rows.select("_order", "_bucket", F.size("_ids").cast("long").alias("_n"))
    placed = running_before(lengths, F.col("_n"), "_order", F.col("_bucket"), out="_start").select("_order", "_start")
    rows = rows.join(placed, "_order")
    last = F.col("_start") + F.size("_ids") - 1
    cut = rows.select("_start", "_ids", F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor(last / width))).alias("stretch"))
    low = F.greatest(F.col("_start"), F.col("stretch") * width)
    high = F.least(F.col("_start") + F.size("_ids"), (F.col("stretch") + 1) * width)
    piece = F.slice("_ids", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int"))
    parts = cut.groupBy("stretch").agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), piece.alias("ids")))).alias("p"))  # `width` ids at most
    return parts.select("stretch", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")).select("stretch", F.size("ids").alias("n"), "ids")


def write_token_stream(stream: DataFrame, path: str, width: int = 1 << 16) -> int:
    """The stream as 16-bit shards: Parquet sorted by stretch, ids little-endian in a binary column; ids above 65535 raise. Returns the number of ids."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            flat = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() > 0xFFFF):
                raise OverflowError("an id does not fit 16 bits")
            ends = np.cumsum(batch.column("n").to_numpy())
            raw = [flat[b - n : b].astype("<u2").tobytes() for b, n in zip(ends, batch.column("n").to_numpy(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("stretch"), batch.column("n"), pa.array(raw, pa.binary())], names=["stretch", "n", "ids"])

    stream.select("stretch", "n", "ids").mapInArrow(packed, "stretch bigint, n int, ids binary").sort("stretch").write.parquet(f"{path}/stretches")
    spark = stream.sparkSession
    total = spark.read.parquet(f"{path}/stretches").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spark.createDataFrame([(int(total), width)], "total bigint, width int").write.parquet(f"{path}/meta")
    return int(total)


def read_token_stream(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((stretch, n, ids), the number of ids, the width of a stretch) of a written stream."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            raw = batch.column("ids").to_pylist()
            ends = np.cumsum([0, *(len(x) // 2 for x in raw)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u2").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("stretch"), batch.column("n"), ids], names=["stretch", "n", "ids"])

    total, width = spark.read.parquet(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/stretches").mapInArrow(unpacked, "stretch bigint, n int, ids array<int>"), total, width


def stream_windows(stream: DataFrame, starts: DataFrame, block: int, width: int = 1 << 16) -> DataFrame:
    """(window, x, y): the `block` ids from each of `starts` (window, start), and those one on. Windows that the stream does not hold whole are left out.

    A window covers few stretches. Each stretch is joined to the windows that ask for it and gives its
    slice alone, and slices are put together by window.
    """
    asked = starts.select("window", F.col("start").cast("long").alias("start")).where("start >= 0")
    last = F.col("start") + block  # y's last id
    asked = asked.select("window", "start", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))).alias("stretch"))
    low = F.greatest(F.lit(0), F.col("start") - F.col("stretch") * width)
    high = F.least(F.col("n").cast("long"), last + 1 - F.col("stretch") * width)
    met = asked.join(stream, "stretch").select("window", "stretch", F.slice("ids", (low + 1).cast("int"), F.greatest(F.lit(0), (high - low)).cast("int")).alias("ids"))
    whole = met.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("stretch", "ids"))).alias("p")).select("window", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    whole = whole.where(F.size("ids") == block + 1)
    return whole.select("window", F.slice("ids", 1, block).alias("x"), F.slice("ids", 2, block).alias("y"))
