"""Vector codes by Lloyd's rounds with Elkan's bounds.

Vectors become integers, are cut into equal parts, and each part is coded by the nearest entry of its
position's codebook. Every vector keeps, for each part, an upper bound of the distance to its entry and a
lower bound of the distance to every entry, from round to round: bounds are shifted by how far entries
moved, and a distance is measured only where no bound and no distance between entries rules the entry
out strictly. What is measured is compared as integers, so ties go to the lower index exactly.

Vectors that are null or hold null or non-finite components take no part, nor do those of another length
than most have (of equally many, the shorter). A length that the number of parts does not divide is
filled up with zeros. The first entries are the vectors of the least ids, of equal ids the least vector;
vectors without an id come last. With fewer vectors there are fewer entries, with none no rows. Repeated
rows are coded each. Components too large for 64-bit squares are computed with unbounded integers; an
error beyond 64 bits is null, and so is its label's. Null labels go together. Only the named columns are
read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_classes, remove_folder, shared_folder

#: Bounds are widened by this share, far more than a double's roundings.
SLACK = 1e-12
_LIMB = 40


def integers(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), as 64-bit or as unbounded integers."""
    x = x.astype(np.float64)
    if not wide:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2**50 else int(v) * scale for v in x.ravel().tolist()]
    return np.array([*exact, None], object)[:-1].reshape(x.shape)


def roots(squares: np.ndarray) -> np.ndarray:
    if squares.dtype == object:
        return np.array([math.sqrt(min(s, 10**300)) for s in squares.ravel().tolist()], float).reshape(squares.shape)
    return np.sqrt(squares)


def up(x: np.ndarray) -> np.ndarray:
    """The least 32-bit number not below x."""
    y = np.minimum(x, 3e38).astype(np.float32)
    return np.where(x > 3e38, np.float32(np.inf), np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)).astype(np.float32)


def down(x: np.ndarray) -> np.ndarray:
    """The greatest 32-bit number not above x."""
    y = np.minimum(x, 3e38).astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y).astype(np.float32)


class Book:
    """One part position's entries, what lies between them, and how far they moved. `measured` counts the distances taken."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = roots(np.stack([self.squares(entries, e) for e in entries])) * (1 - SLACK) / 2
        np.fill_diagonal(apart, np.inf)
        self.half, self.nearest = apart, apart.min(axis=1)
        self.moved = roots(((entries - before) ** 2).sum(axis=1)) * (1 + SLACK) if before is not None else None
        self.measured = 0

    def squares(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x - entry) ** 2).sum(axis=1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, upper bound, lower bounds) of parts met for the first time."""
        squares = np.stack([self.squares(x, e) for e in self.entries], axis=1)
        self.measured += squares.size
        code = np.argmin(squares, axis=1)  # the lowest of equal ones
        far = roots(squares)
        return code, up(far[np.arange(len(x)), code] * (1 + SLACK)), down(far * (1 - SLACK))

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after entries moved, from the bounds of the round before."""
        code = code.copy()
        upper = up(upper.astype(np.float64) * (1 + SLACK) + self.moved[code])
        lower = down(np.maximum(lower.astype(np.float64) - self.moved, 0))
        rows = np.flatnonzero(~(upper < self.nearest[code]))
        open_ = self._open(upper[rows], lower[rows], code[rows])
        some = open_.any(axis=1)
        rows = rows[some]
        if not len(rows):
            return code, upper, lower
        # the distance to the own entry first: it may rule the others out
        part, own = x[rows], code[rows]
        least = self.squares(part, self.entries[own])
        self.measured += len(rows)
        far = roots(least)
        upper[rows], lower[rows, own] = up(far * (1 + SLACK)), down(far * (1 - SLACK))
        open_ = self._open(upper[rows], lower[rows], own)
        best = own.copy()
        for j in range(len(self.entries)):
            at = np.flatnonzero(open_[:, j])
            if not len(at):
                continue
            squares = self.squares(part[at], self.entries[j])
            self.measured += len(at)
            lower[rows[at], j] = down(roots(squares) * (1 - SLACK))
            better = np.asarray((squares < least[at]) | ((squares == least[at]) & (j < best[at])), bool)
            best[at[better]], least[at[better]] = j, squares[better]
        moved = best != own
        code[rows[moved]] = best[moved]
        upper[rows[moved]] = up(roots(least[moved]) * (1 + SLACK))
        return code, upper, lower

    def _open(self, upper: np.ndarray, lower: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Which entries neither bound rules out; the own one is not asked about."""
        u = upper[:, None].astype(np.float64)
        out = ~(u < lower) & ~(u < self.half[code])
        out[np.arange(len(code)), code] = False
        return out


def _cells(column: pa.Array, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    """The numbers packed in a binary column without nulls."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), *shape)


def _packed(x: np.ndarray) -> pa.Array:
    raw, n = np.ascontiguousarray(x), len(x)
    width = raw.nbytes // n if n else 0
    return pa.array([raw[i].tobytes() for i in range(n)] if width else [b""] * n, pa.binary())


class Codec:
    """The books of all part positions, applied to batches."""

    def __init__(self, books: list[np.ndarray], before: list[np.ndarray] | None, length: int, scale: int, wide: bool, float_kind: str):
        self.books = [Book(e, before[p] if before else None) for p, e in enumerate(books)]
        self.parts, self.entries = len(books), len(books[0])
        self.length, self.scale, self.wide, self.float_kind = length, scale, wide, float_kind
        self.width = -(-length // self.parts)

    def cut(self, column: pa.Array) -> list[np.ndarray]:
        """The integers of each part position."""
        x = integers(_cells(column, self.float_kind, (self.length,)), self.scale, self.wide)
        if (more := self.width * self.parts - self.length) :
            x = np.concatenate([x, np.zeros((len(x), more), x.dtype)], axis=1)
        return [x[:, p * self.width : (p + 1) * self.width] for p in range(self.parts)]

    def start(self, batch: pa.RecordBatch) -> list[tuple]:
        return [b.first(x) for b, x in zip(self.books, self.cut(batch.column("vector")), strict=True)]

    def follow(self, batch: pa.RecordBatch) -> list[tuple]:
        code = _cells(batch.column("code"), "u1", (self.parts,))
        upper = _cells(batch.column("upper"), "<f4", (self.parts,))
        lower = _cells(batch.column("lower"), "<f4", (self.parts, self.entries))
        parts = self.cut(batch.column("vector"))
        return [b.again(x, code[:, p].astype(np.int64), upper[:, p], lower[:, p]) for p, (b, x) in enumerate(zip(self.books, parts, strict=True))]


def _state(rows: DataFrame, codec: Codec, first: bool) -> DataFrame:
    names = ["id", "label", "vector", "code", "upper", "lower"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = codec.start(batch) if first else codec.follow(batch)
                columns = [np.stack([f[0] for f in found], 1).astype(np.uint8), np.stack([f[1] for f in found], 1), np.stack([f[2] for f in found], 1)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:3]] + [_packed(c) for c in columns], names=names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, vector binary, code binary, upper binary, lower binary")


def _sums(state: DataFrame, codec: Codec) -> list[list[tuple[int, list[int]]]]:
    """(parts, their sums) of each entry of each book. A task sends its sums once; they are as many as the books' numbers."""
    width = codec.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = object if codec.wide else np.int64
        held = np.zeros((codec.parts, codec.entries, width + 1), kind)
        for batch in batches:
            code = _cells(batch.column("code"), "u1", (codec.parts,))
            for p, x in enumerate(codec.cut(batch.column("vector"))):
                np.add.at(held[p], code[:, p], np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1))
        rows = []
        for cell, value in enumerate(held.ravel().tolist()):
            limb, sign, value = 0, -1 if value < 0 else 1, abs(value)
            while value:
                rows.append((cell, limb, sign * (value & ((1 << _LIMB) - 1))))
                value, limb = value >> _LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["cell", "limb", "value"])

    told = state.select("vector", "code").mapInArrow(run, "cell int, limb int, value bigint").groupBy("cell", "limb").agg(F.sum("value").alias("value"))
    flat = [0] * (codec.parts * codec.entries * (width + 1))
    for cell, limb, value in told.collect():
        flat[cell] += value << (_LIMB * limb)
    at = lambda p, e: (p * codec.entries + e) * (width + 1)
    return [[(flat[at(p, e) + width], flat[at(p, e) : at(p, e) + width]) for e in range(codec.entries)] for p in range(codec.parts)]


def compress_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every vector.

    A round reads the vectors with their bounds, writes them anew to the shared folder and removes the
    last round's; sums of the new entries' parts come from a second read of codes alone. Nothing is
    shuffled but a task's sums, and only the books, of fixed size, come to the driver and go to tasks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    spark = vectors.sparkSession
    top = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    double = "double" in dict(vectors.dtypes)[vector_col]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col("v").isNotNull() & finite)
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    usual = kept.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), largest.alias("most")).orderBy(F.desc("n"), "length").first()
    kind = dict(rows.dtypes)
    columns = lambda d: d.select(F.col("id").alias(id_col), "label", "code", "error", "label_error", "codebooks_sha256")
    if usual is None:
        return columns(spark.createDataFrame([], f"id {kind['id']}, label {kind['label']}, code string, error bigint, label_error bigint, codebooks_sha256 string"))
    length, width = usual.length, -(-usual.length // parts)
    wide = scale * (usual.most or 0.0) + 1 >= 2.0**30 / max(width, 1) ** 0.5  # squared distances of a part beyond 64 bits
    kept = kept.where(F.size("v") == length)
    first = [r.v for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    float_kind = "<f8" if double else "<f4"
    make = lambda books, before: Codec(books, before, length, scale, wide, float_kind)
    x = integers(np.array(first, float).reshape(len(first), length), scale, wide)
    x = np.concatenate([x, np.zeros((len(x), width * parts - length), x.dtype)], axis=1)
    books = [x[:, p * width : (p + 1) * width] for p in range(parts)]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float_kind).reshape(len(batch), length)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _packed(v)], names=["id", "label", "vector"])

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.parquet(f"{top}/{name}")

    codec = make(books, None)
    state = stored(_state(kept.mapInArrow(packed, f"id {kind['id']}, label {kind['label']}, vector binary"), codec, True), "0")
    for r in range(1, rounds + 1):
        before, books = books, []
        for book, sums in zip(before, _sums(state, codec), strict=True):
            new = book.copy()
            for e, (n, total) in enumerate(sums):
                if n:
                    new[e] = [t // n for t in total]
            books.append(new)
        codec = make(books, before)
        state = stored(_state(state, codec, False), str(r))
        remove_folder(spark, f"{top}/{r - 1}")
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    coded = stored(_errors(state, codec), "coded")
    remove_folder(spark, f"{top}/{rounds}")
    total = coded.count()
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string"))).alias("key")
    coded = coded.select("*", key)
    sums = F.when(F.count("error") == F.count("*"), F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS bigint)"))
    labels = coded.groupBy("key").agg(F.count("*").alias("n"), sums.alias("label_error"))
    return columns(join_classes(coded, labels, "key", total).withColumn("codebooks_sha256", F.lit(digest)))


def _errors(state: DataFrame, codec: Codec) -> DataFrame:
    """(id, label, code, error): codes as hexadecimal digits and exact squared distances to the coded entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _cells(batch.column("code"), "u1", (codec.parts,))
            error = sum(b.squares(x, b.entries[code[:, p]]) for p, (b, x) in enumerate(zip(codec.books, codec.cut(batch.column("vector")), strict=True)))
            exact = [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(exact, pa.int64())], names=["id", "label", "code", "error"])

    kinds = dict(state.dtypes)
    return state.select("id", "label", "vector", "code").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")
