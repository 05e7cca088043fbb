"""Structured Streaming forms: a bounded read, deduplication and log triage."""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..checkpoints import hadoop
from ..operators.scan import LOG_FAMILIES


def committed(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes of text of each batch of a bounded read that is written and logged at `path`."""
    system, top = hadoop(spark, f"{path}/_log")
    if not system.exists(top):
        return {}
    names = [f.getPath().getName() for f in system.listStatus(top)]
    done = [n for n in names if system.exists(hadoop(spark, f"{path}/_log/{n}/_SUCCESS")[1])]
    return {r.batch: r.bytes for r in spark.read.schema("batch bigint, bytes bigint").json([f"{path}/_log/{n}" for n in done]).collect()} if done else {}


def read_until(stream: DataFrame, path: str, checkpoint: str, *, text_col: str, target_bytes: int, timeout: int = 600) -> int:
    """Write a stream's rows as Parquet until `target_bytes` of text are there or the stream has no more; the micro-batch that crosses it is kept. Returns the bytes written.

    Each micro-batch is a folder `batch=n`, written over what an interrupted try has left, and then logged
    with its bytes. The log is what counts: a read that is started again with the same `path` and
    `checkpoint` goes on from it, a replayed batch that is logged is not written again, and at the target
    nothing is read any more. So a read that was killed anywhere ends with the rows of one run.

    Fewer bytes than the target mean that a run over all that is there found nothing new. A read that fails
    raises its error, and one that is not done after `timeout` seconds a TimeoutError; what is logged stays.
    """
    spark = stream.sparkSession
    done = committed(spark, path)
    full = lambda: sum(done.values()) >= target_bytes

    def write(batch: DataFrame, number: int) -> None:
        if number in done:
            return
        if full():
            raise RuntimeError("the target is reached")  # so that this batch is not taken for done, and is there for a later read
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        size = spark.read.schema(batch.schema).parquet(f"{path}/batch={number}").agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
        spark.createDataFrame([(number, int(size))], "batch bigint, bytes bigint").coalesce(1).write.mode("overwrite").json(f"{path}/_log/{number:08d}")
        done[number] = int(size)

    until = time.monotonic() + timeout
    while not full():
        before = len(done)
        query: StreamingQuery = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            while not query.awaitTermination(0.5):  # raises what ended the query
                if full():
                    break
                if time.monotonic() >= until:
                    raise TimeoutError(f"{sum(done.values())} of {target_bytes} bytes are written after {timeout} seconds")
        except StreamingQueryException:
            if not full():
                raise
        finally:
            query.stop()
        if len(done) == before:  # the query went through all that is there
            break
    return sum(done.values())


def dedup_stream(stream: DataFrame, text_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Exact copies off, among rows within the watermark's delay; the state held is of that span only."""
    return stream.withColumn("_k", F.md5(text_col)).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def triage_stream(stream: DataFrame, line_col: str, time_col: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Lines of each family in each time window."""
    hits = F.array_compact(F.array(*[F.when(F.col(line_col).rlike(p), F.lit(n)) for n, p in LOG_FAMILIES.items()]))
    rows = stream.withWatermark(time_col, delay).select(time_col, F.explode(hits).alias("family"))
    return rows.groupBy(F.window(time_col, window), "family").agg(F.count("*").alias("n"))
