"""A stored set of keys, for deduplication across runs.

Keys are 128-bit digests. A run of them is written sorted, a file for each range of their first bits, and
a Bloom filter for each file; a small list names the live runs. New keys are put to the filters first, so
only files that may hold one of them are opened, and then joined to these.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, hadoop
from .dedup import keep_first

_PROBES = 7
_BITS = 10  # for each key: one false hit in about a hundred


def _places(keys: list[bytes], size: int) -> np.ndarray:
    """The bits that each key sets in a filter of `size` bits, a row each."""
    halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    a, b = halves[:, :1] * np.uint64(0x9E3779B97F4A7C15), halves[:, 1:] | np.uint64(1)
    return ((a ^ (a >> np.uint64(31))) + np.arange(_PROBES, dtype=np.uint64) * b) % np.uint64(size)


def bloom(keys: list[bytes]) -> bytes:
    size = max(64, _BITS * len(keys)) // 8 * 8
    held = np.zeros(size, np.uint8)
    held[_places(keys, size).ravel()] = 1
    return np.packbits(held).tobytes()


def may_hold(filter_: bytes, keys: list[bytes]) -> np.ndarray:
    """Whether each key may be among those of a filter; never false for one that is."""
    if not keys:
        return np.zeros(0, bool)
    bits = np.frombuffer(filter_, np.uint8)
    at = _places(keys, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


class KeyStore:
    """A set of 16-byte keys at `path`, on any file system that Spark writes to.

    `per_file` keys are about what a file holds; past `most_runs` runs are merged. A batch has a name:
    adding one that is there already does nothing, so a repeated run is harmless. Runs become live by the
    last write, of the list; what a failed run leaves is never read. `opened` and `files` count the files
    that the last probe opened and could have opened.
    """

    def __init__(self, spark: SparkSession, path: str, per_file: int = 1_000_000, most_runs: int = 8, broadcast_bytes: int = 32 << 20):
        self.spark, self.path, self.per_file, self.most_runs, self.broadcast_bytes = spark, path, per_file, most_runs, broadcast_bytes
        self.opened = self.files = 0

    def _lists(self) -> list[int]:
        system, top = hadoop(self.spark, f"{self.path}/live")
        if not system.exists(top):
            return []
        names = [f.getPath().getName() for f in system.listStatus(top)]
        return sorted(int(n) for n in names if system.exists(hadoop(self.spark, f"{self.path}/live/{n}/_SUCCESS")[1]))

    def runs(self) -> list[tuple[str, int, int, list[str]]]:
        """(name, keys, bits of its ranges, batches in it) of each live run."""
        versions = self._lists()
        if not versions:
            return []
        rows = self.spark.read.schema("run string, n bigint, bits int, batches array<string>").json(f"{self.path}/live/{versions[-1]:08d}").collect()
        return sorted((r.run, r.n, r.bits, r.batches) for r in rows)

    def _range(self, key: Column, bits: int) -> Column:
        return F.shiftright(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint"), 32 - bits).cast("int")

    def _write_run(self, keys: DataFrame, batches: list[str]) -> tuple[str, int, int, list[str]]:
        n = keys.count()
        bits = min(24, max(0, (n // self.per_file).bit_length()))
        name = uuid.uuid4().hex
        ranged = keys.select(F.col("key"), self._range(F.col("key"), bits).alias("part")).repartition("part").sortWithinPartitions("part", "key")
        ranged.write.partitionBy("part").parquet(f"{self.path}/runs/{name}/keys")

        def filters(frame: pd.DataFrame) -> pd.DataFrame:  # a range holds about per_file keys, as digests are even
            return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "filter": [bloom(frame["key"].tolist())]})

        stored = self.spark.read.parquet(f"{self.path}/runs/{name}/keys").select("part", "key") if n else self.spark.createDataFrame([], "part int, key binary")
        stored.groupBy("part").applyInPandas(filters, "part int, filter binary").write.parquet(f"{self.path}/runs/{name}/filters")
        return name, n, bits, batches

    def _commit(self, runs: list[tuple[str, int, int, list[str]]]) -> None:
        versions = self._lists()
        rows = self.spark.createDataFrame(runs, "run string, n bigint, bits int, batches array<string>")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/live/{(versions[-1] if versions else 0) + 1:08d}")

    def add(self, keys: DataFrame, batch: str) -> None:
        """The distinct keys of `keys` (key), none of which is stored yet, as a run of their own."""
        runs = self.runs()
        if any(batch in r[3] for r in runs):
            return
        self._commit([*runs, self._write_run(checkpointed(keys.select("key").distinct()), [batch])])
        if len(runs) >= self.most_runs:
            self.merge()

    def merge(self) -> None:
        """All runs but those over twice as large as the smaller ones together become one."""
        runs, small, held = sorted(self.runs(), key=lambda r: r[1]), [], 0
        for r in runs:
            if len(small) < 2 or r[1] <= 2 * held:
                small.append(r)
                held += r[1]
        if len(small) > 1:
            stored = [self.spark.read.parquet(f"{self.path}/runs/{r[0]}/keys").select("key") for r in small if r[1]]
            keys = reduce(DataFrame.unionByName, stored, self.spark.createDataFrame([], "key binary"))
            merged = self._write_run(keys.distinct(), sorted(b for r in small for b in r[3]))
            self._commit([r for r in runs if r not in small] + [merged])

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of `keys` (key: binary) that are stored, checkpointed."""
        keys = checkpointed(keys.select("key"))
        out, self.opened, self.files = self.spark.createDataFrame([], "key binary"), 0, 0
        for name, n, bits, _ in self.runs():
            if n:
                out = out.unionByName(self._known_in(keys, name, n, bits))
        return checkpointed(out.distinct())

    def _known_in(self, keys: DataFrame, name: str, n: int, bits: int) -> DataFrame:
        ranged = keys.select("key", self._range(F.col("key"), bits).alias("part"))
        filters = self.spark.read.parquet(f"{self.path}/runs/{name}/filters")
        if n * _BITS // 8 <= self.broadcast_bytes:
            table = self.spark.sparkContext.broadcast({r.part: bytes(r.filter) for r in filters.collect()})
            hits = ranged.mapInArrow(lambda batches: _tested(((b, table.value) for b in batches)), "key binary, part int")
        else:  # many files: filters and keys meet by range, filters first
            both = ranged.select("part", F.lit(1).alias("kind"), "key").unionByName(filters.select("part", F.lit(0).alias("kind"), F.col("filter").alias("key")))
            hits = both.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_met, "key binary, part int")
        hits = checkpointed(hits)
        files = [r.part for r in hits.select("part").distinct().collect()]
        self.files += filters.count()
        self.opened += len(files)
        stored = self.spark.read.parquet(f"{self.path}/runs/{name}/keys").where(F.col("part").isin(files)).select("key")
        return hits.select("key").join(stored, "key", "left_semi")

    def write_fresh(self, df: DataFrame, key: Column, order: Sequence[str], path: str, batch: str) -> DataFrame:
        """The first row of each key that is not stored, written to `path`/batch=`batch`, its keys added; read back from there.

        Rows are written before their keys become live, over what an interrupted try of the batch has
        left; a batch that is live is not written again.
        """
        out = f"{path}/batch={batch}"
        if not any(batch in r[3] for r in self.runs()):
            first = keep_first(df.withColumn("_key", F.unhex(F.md5(key.cast("binary")))), "_key", order)
            fresh = checkpointed(first)
            fresh = fresh.join(self.known(fresh.select(F.col("_key").alias("key"))).withColumnRenamed("key", "_key"), "_key", "left_anti")
            fresh.write.mode("overwrite").parquet(out)
            self.add(self.spark.read.parquet(out).select(F.col("_key").alias("key")), batch)
        return self.spark.read.parquet(out).drop("_key")


def _tested(batches: Iterator[tuple[pa.RecordBatch, dict[int, bytes]]]) -> Iterator[pa.RecordBatch]:
    for batch, filters in batches:
        part = batch.column("part").to_numpy()
        hit = np.zeros(len(part), bool)
        order = np.argsort(part, kind="stable")
        keys = batch.column("key").to_pylist()
        for p, at in zip(*np.unique(part[order], return_index=True), strict=True):
            mine = order[at : at + int((part == p).sum())]
            if int(p) in filters:
                hit[mine] = may_hold(filters[int(p)], [keys[i] for i in mine])
        yield batch.filter(pa.array(hit)).select(["key", "part"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that may be in their range's filter, which stands before them; one filter is held at a time."""
    range_, filter_ = None, None
    for batch in batches:
        parts, kinds, keys = (batch.column(c).to_pylist() for c in ("part", "kind", "key"))
        found: list[tuple[bytes, int]] = []
        at = 0
        while at < len(parts):
            if kinds[at] == 0:
                range_, filter_ = parts[at], keys[at]
                at += 1
                continue
            to = at
            while to < len(parts) and kinds[to] == 1 and parts[to] == parts[at]:
                to += 1
            if filter_ is not None and range_ == parts[at]:
                found += [(k, parts[at]) for k, h in zip(keys[at:to], may_hold(filter_, keys[at:to]), strict=True) if h]
            at = to
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([p for _, p in found], pa.int32())], names=["key", "part"])
