"""A count of hashed values in a table of fixed size, gathered without any task or the driver holding more than that table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

SLICES = 64


def cells(values: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each 64-bit hash: its top bits."""
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """32-bit counts by byte places: the lowest by letter frequencies alone unless nearly all are zero, the upper ones, which nearly all are, by repeats."""
    planes = counts.view(np.uint8).reshape(-1, 4)
    low = np.ascontiguousarray(planes[:, 0])
    crowded = np.count_nonzero(low) * 8 > len(low)
    coder = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY if crowded else zlib.Z_DEFAULT_STRATEGY)
    return coder.compress(low) + coder.flush() + zlib.compress(np.ascontiguousarray(planes[:, 1:].T), 1)


def unpacked(raw: bytes) -> np.ndarray:
    coder = zlib.decompressobj()
    low = coder.decompress(raw)
    planes = np.frombuffer(low + zlib.decompress(coder.unused_data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def count_cells(df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]], bits: int, tables: int = 1) -> list[np.ndarray]:
    """How often each cell is met, for each of `tables` tables, over all rows of `df`.

    `values` turns a batch into pieces of work, each one hash array for each table. A task adds up its
    rows in tables of 2**bits 32-bit counts and sends them once, compressed, by slices; slices are added
    up by streaming, and the driver gets the sums: 4 * tables * 2**bits bytes at any size of input.
    """
    size = 1 << bits
    part = size // SLICES

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(size, np.uint32) for _ in range(tables)]
        rows = 0

        def told() -> Iterator[pa.RecordBatch]:
            for t, counts in enumerate(held):
                raw = [packed(counts[k * part : (k + 1) * part]) for k in range(SLICES)]
                yield pa.RecordBatch.from_arrays([pa.array(range(t * SLICES, (t + 1) * SLICES), pa.int32()), pa.array(raw, pa.binary())], names=["slice", "counts"])

        for batch in batches:
            for piece in values(batch):
                for counts, v in zip(held, piece, strict=True):
                    np.add.at(counts, cells(v, bits), 1)
                rows += len(piece[0])
        if rows:
            yield from told()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                there = sums.setdefault(k, np.zeros(part, np.uint32))
                there += np.minimum(unpacked(raw), ~there)  # stays at the top once there
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["slice", "counts"])

    told = df.mapInArrow(tally, "slice int, counts binary").repartition(min(tables * SLICES, partitions(df.sparkSession)), "slice").mapInArrow(add, "slice int, counts binary")
    out = [np.zeros(size, np.uint32) for _ in range(tables)]
    for k, raw in told.collect():  # in one job; compressed, and no more than the tables
        t, k = divmod(k, SLICES)
        out[t][k * part : (k + 1) * part] = np.frombuffer(zlib.decompress(raw), np.uint32)
    return out


class Counts:
    """A table of counts that takes 16 bits a cell; those that need more, which are few for their sum, stand apart."""

    def __init__(self, counts: np.ndarray):
        self.low = np.minimum(counts, 0xFFFF).astype(np.uint16)
        self.where = np.flatnonzero(self.low == 0xFFFF)
        self.full = counts[self.where]

    def __getitem__(self, cell: np.ndarray) -> np.ndarray:
        out = self.low[cell].astype(np.uint32)
        top = np.flatnonzero(out == 0xFFFF)
        if len(top):
            out[top] = self.full[np.searchsorted(self.where, cell[top])]
        return out


def bits_for(values: int, least: int = 12, most: int = 27) -> int:
    """Bits of a bitmap with 64 to 128 cells for each value, in bounds."""
    return min(most, max(least, (64 * values).bit_length()))


def met_cells(df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """A bitmap of the cells that any row of `df` meets, gathered as counts are; `values` gives the hashes of a batch."""
    part = (1 << bits) // 8 // SLICES

    def told(slices: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([zlib.compress(x, 1) for x in slices.values()], pa.binary())], names=["slice", "cells"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(part * SLICES, np.uint8)
        for batch in batches:
            cell = cells(values(batch), bits)
            np.bitwise_or.at(held, cell >> 3, (128 >> (cell & 7)).astype(np.uint8))
        pieces = {k: held[k * part : (k + 1) * part] for k in range(SLICES)}
        pieces = {k: x for k, x in pieces.items() if x.any()}
        if pieces:
            yield told(pieces)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                there = met.setdefault(k, np.zeros(part, np.uint8))
                there |= np.frombuffer(zlib.decompress(raw), np.uint8)
        if met:
            yield told(met)

    found = df.mapInArrow(mark, "slice int, cells binary").repartition(min(SLICES, partitions(df.sparkSession)), "slice").mapInArrow(add, "slice int, cells binary")
    out = np.zeros(part * SLICES, np.uint8)
    for k, raw in found.collect():
        out[k * part : (k + 1) * part] = np.frombuffer(zlib.decompress(raw), np.uint8)
    return out


def member_test(spark: SparkSession, df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], expected: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test of 64-bit hashes against those of `df`: true where they are met, and by chance for one or two in a hundred others.

    Its bitmap, of at most 2**27 bits (16 MB; for more than two million values chance hits grow), is
    broadcast; it spares rows a shuffle before an exact join.
    """
    bits = bits_for(expected)
    table = spark.sparkContext.broadcast(met_cells(df, values, bits))

    def test(hashes: np.ndarray) -> np.ndarray:
        cell = cells(hashes, bits)
        return (table.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0

    return test


def split_by_keys(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in `keys`, rows whose key is or may be), in the columns of `docs`.

    A table joined to few keys is split first, so that the many rows without a match are not shuffled. A
    null key is not in `keys`.
    """

    def hashed(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("h").to_numpy().view(np.uint64)

    keys = keys.select(F.xxhash64(keys.columns[0]).alias("h"))
    test = member_test(docs.sparkSession, keys, hashed, keys.count())

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(test(h.to_numpy(np.int64).view(np.uint64)))

    met = F.coalesce(key.isNotNull() & may(F.xxhash64(key)), F.lit(False))
    return docs.where(~met), docs.where(met)
