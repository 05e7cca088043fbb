"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length and turned by fast Hadamard pseudo-rotations (three rounds of random
signs and a Hadamard transform); a hash is the nearest signed axis, and a table's bucket is the nearest
axes under as many rotations as keep buckets small, so buckets grow in number with the rows. A query
probes, in every table, the buckets nearest to it. Candidates are ranked by the exact inner product of
the original vectors in double precision.

How many buckets are probed is fitted: for a bounded sample of queries the true neighbours are found by
one pass over all rows, and the least number that reaches the recall asked for is taken. A query whose
probes reach fewer than `k` others probes everything: it meets all rows, in blocks.

Vectors that are null, zero, of another length than the most common one (the shorter, if two are), or
hold null or non-finite components take no part, nor do rows without an id. Equal vectors are searched
once: a class keeps its smallest ids, as many as a result can hold; equal scores go by the smaller id.
Rows that repeat an id with equal vectors are one; with different ones each vector counts, and the id's
best score. Only id and vector are read, so other names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_classes

_COMBINATIONS = 1 << 14  # of axes that a query may probe in a table


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; a power of two wide, scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """Tables of pseudo-rotations for vectors of one length; a bucket is named by `axes` signed axes."""

    def __init__(self, dim: int, tables: int, axes: int = 1, seed: int = 7):
        self.width, self.tables, self.axes = 1 << max(0, (dim - 1).bit_length()), tables, axes
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], size=(tables, axes, 3, self.width))
        self.sides = 2 * self.width
        #: of each rotation, so many axes are tried in probing
        self.wide = min(self.sides, max(2, int(_COMBINATIONS ** (1 / axes) + 1e-9)))

    def turned(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each rotation, all signed axes' inner products with each unit vector: those of the axes, then of their opposites."""
        unit = np.zeros((len(x), self.width))
        unit[:, : x.shape[1]] = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        out = []
        for rounds in self.signs[table]:
            y = unit
            for signs in rounds:
                y = hadamard(y * signs)
            out.append(np.concatenate([y, -y], axis=1))
        return out

    def code(self, axes: list[np.ndarray], table: int) -> np.ndarray:
        out = np.full_like(axes[0], table)
        for a in axes:
            out = out * self.sides + a
        return out

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector."""
        return self.code([y.argmax(axis=1) for y in self.turned(x, table)], table)

    def probes(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """The buckets nearest to each vector by the sum of their axes' inner products, the nearest first."""
        total = codes = None
        for y in self.turned(x, table):
            axis = np.argsort(-y, axis=1, kind="stable")[:, : self.wide]
            score = np.take_along_axis(y, axis, 1)
            if total is None:
                total, codes = score, table * self.sides + axis
            else:
                total = (total[:, :, None] + score[:, None, :]).reshape(len(x), -1)
                codes = (codes[:, :, None] * self.sides + axis[:, None, :]).reshape(len(x), -1)
        most = min(most, total.shape[1])
        near = np.argpartition(-total, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(total, near, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(codes, near, 1)

    def least_probes(self, queries: np.ndarray, pairs: np.ndarray, neighbours: np.ndarray, recall: float) -> int:
        """The fewest probes a table by which that share of (query number, neighbour) pairs meets in some table; all, if none does."""
        best = np.full(len(pairs), self.wide**self.axes)
        for t in range(self.tables):
            there = self.buckets(neighbours, t)
            for q in range(len(queries)):
                own = np.flatnonzero(pairs == q)
                if len(own):
                    order = self.probes(queries[q : q + 1], t, self.wide**self.axes)[0]
                    by = np.argsort(order)
                    at = np.minimum(np.searchsorted(order[by], there[own]), len(order) - 1)
                    met = order[by][at] == there[own]
                    best[own] = np.minimum(best[own], np.where(met, by[at] + 1, len(order)))
        need = np.sort(best)
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) if len(need) else 1


def best_of(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, place in `ids`, score) of each query's best, in the end by the smaller id, for queries in parts."""
    top = min(most, len(ids))
    for at in range(0, len(q), 256):
        score = q[at : at + 256] @ x.T
        if top < len(ids):
            least = -np.partition(-score, top - 1, axis=1)[:, top - 1]
            i, j = np.nonzero(score >= least[:, None])  # with all ties of the last
        else:
            i, j = np.nonzero(np.ones_like(score, bool))
        if len(i) > top * len(score):
            order = np.lexsort((ids[j], -score[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < top
            i, j = i[keep], j[keep]
        yield asked[at + i], j, score[i, j]


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20,
    tables: int = 12, axes: int | None = None, bucket_rows: int = 2048, probes: int | None = None, recall: float = 0.95, sample: int = 256, block_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, the `k` nearest found among all others.

    `axes`, unless given, is the fewest rotations a table that make buckets of at most `bucket_rows` rows on
    average; `probes`, unless given, is fitted on `sample` queries, chosen by hash, to `recall`. A bucket is
    split into blocks of about `block_rows` vectors, which its queries all meet, so a crowded bucket is
    spread and nothing is cut off. Crowded buckets, of which there are at most tables * rows / block_rows,
    are broadcast up to a million.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    part = np.float64 if "double" in dict(vectors.dtypes)[vector_col] else np.float32
    rows = vectors.selectExpr(f"cast(`{id_col}` AS bigint) AS id", f"cast(`{vector_col}` AS array<{'double' if part is np.float64 else 'float'}>) AS v").where("id IS NOT NULL AND size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if found is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` {kind}, score double")
    dim, total = found
    rows = rows.where(F.size("v") == dim)
    asked = F.col("id") % every == 0
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    size = classes.count()
    if axes is None:
        axes, sides = 1, 2 << max(0, (dim - 1).bit_length())
        while size > bucket_rows * sides**axes and axes < 4:
            axes += 1
    # classes go by their vectors' number, as an id may have more than one
    classes = cut(classes.select("v", "n", F.monotonically_increasing_id().alias("c"), "rep"))
    member = cut(join_classes(rows, classes.drop("rep"), "v", total).select("c", "id").distinct())
    # the k + 1 smallest ids of each class: ranked within the class; a crowded class is dealt out first
    inner = Window.partitionBy("c", F.pmod(F.hash("id"), F.lit(64))).orderBy("id")
    outer = Window.partitionBy("c").orderBy("id")
    few = member.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(outer)).where(F.col("r") <= k + 1).drop("r")
    queries = cut(member.where(asked).select(F.col("id").alias("query_id"), F.col("c").alias("q")))
    asking = cut(classes.join(queries.select(F.col("q").alias("c")).distinct(), "c").select("c", "rep", "v"))

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), dtype=part).reshape(-1, dim)

    def fitted() -> int:
        """Probes a table, from the true neighbours of a sample of queries."""
        drawn = asking.orderBy(F.xxhash64("rep"), "rep", "c").limit(sample).collect()
        if not drawn:
            return 1
        x = np.array([r.v for r in drawn], float)
        shared = spark.sparkContext.broadcast((np.array([r.c for r in drawn]), x))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            kept = None
            for batch in batches:
                for at in range(0, len(batch), 8192):
                    piece = batch.slice(at, 8192)
                    raw = matrix(piece.column("v"))
                    c = piece.column("c").to_numpy()
                    got = [np.concatenate(z) for z in zip(*best_of(np.arange(len(q)), q, c, raw.astype(float), k + 1), strict=True)]
                    frame = pd.DataFrame({"q": got[0], "c": c[got[1]], "x": [r.tobytes() for r in raw[got[1]]], "score": got[2]})
                    kept = pd.concat([kept, frame]).sort_values(["q", "score", "c"], ascending=[True, False, True]).groupby("q").head(k + 1)
            if kept is not None:
                kept = kept[kept["c"].to_numpy() != own[kept["q"].to_numpy()]]
                yield pa.RecordBatch.from_pandas(kept[["q", "c", "x", "score"]], preserve_index=False)

        near = classes.select("c", "v").mapInArrow(exact, "q bigint, c bigint, x binary, score double")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("r") <= k).select("q", "x").collect()
        if not near:
            return 1
        return CrossPolytope(dim, tables, axes).least_probes(x, np.array([r.q for r in near]), np.array([np.frombuffer(r.x, part) for r in near], float), recall)

    probes = probes or fitted()

    def hashed(probe: int | None):
        """A row for each vector and bucket: the one it lies in, or those it probes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            polytope = CrossPolytope(dim, tables, axes)
            for batch in batches:
                for at in range(0, len(batch), 256 if axes > 1 and probe else 2048):
                    piece = batch.slice(at, 256 if axes > 1 and probe else 2048)
                    x = matrix(piece.column("v"))
                    raw, c, rep = [r.tobytes() for r in x], piece.column("c").to_numpy(), piece.column("rep").to_numpy()
                    for t in range(tables):
                        b = polytope.buckets(x.astype(float), t)[:, None] if probe is None else polytope.probes(x.astype(float), t, probe)
                        n = b.shape[1]
                        for j in range(0, n, 64):
                            m = min(64, n - j)
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, m)), pa.array([r for r in raw for _ in range(m)], pa.binary()), pa.array(b[:, j : j + m].ravel().astype(np.int64)), pa.array(np.repeat(rep, m))], names=["c", "x", "bucket", "rep"])

        return run

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "c": [], "rep": [], "score": []})
        x, q = (np.frombuffer(b"".join(f["x"]), part).reshape(-1, dim).astype(float) for f in (left, right))
        ids, asked = left["c"].to_numpy(), right["c"].to_numpy()
        reps = left["rep"].to_numpy()
        return pd.concat([pd.DataFrame({"q": a, "c": ids[j], "rep": reps[j], "score": s}) for a, j, s in best_of(asked, q, reps, x, k + 1)])

    schema, shape = "c bigint, x binary, bucket bigint, rep bigint", "q bigint, c bigint, rep bigint, score double"

    def hits(ranked: DataFrame) -> DataFrame:
        """(query_id, id, score), a query's k best at most, from (q, c, rep, score)."""
        best = ranked.groupBy("q", "c", "rep").agg(F.max("score").alias("score"))
        best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep", "c"))).where(F.col("r") <= k + 1).drop("r", "rep")
        named = best.join(few, "c").select("q", "id", "score").join(queries, "q").where(F.col("id") != F.col("query_id"))
        return named.groupBy("query_id", "id").agg(F.max("score").alias("score"))

    points = classes.select("c", "rep", "v").mapInArrow(hashed(None), schema)
    crowded = cut(points.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    crowded = F.broadcast(crowded) if crowded.count() <= 1_000_000 else crowded
    blocks = F.coalesce("blocks", F.lit(1))
    points = points.join(crowded, "bucket", "left").withColumn("block", F.pmod(F.hash("c"), blocks))
    probing = asking.select("c", "rep", "v").mapInArrow(hashed(probes), schema).join(crowded, "bucket", "left")
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = cut(hits(points.groupBy("bucket", "block").cogroup(probing.groupBy("bucket", "block")).applyInPandas(rank, shape)))

    # a query that reached too few probes everything: it meets all classes, in blocks
    short = met.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = cut(queries.join(short, "query_id", "left_anti"))
    if short.take(1):
        dealt = max(1, -(-size // block_rows))
        packed = lambda x: pd.Series([np.asarray(v, part).tobytes() for v in x])
        packed.__annotations__ = {"x": pd.Series, "return": pd.Series}
        as_bytes = F.pandas_udf(packed, "binary")
        everyone = classes.select("c", "rep", as_bytes("v").alias("x"), F.pmod(F.hash("c"), F.lit(dealt)).alias("block"))
        again = asking.join(short.select(F.col("q").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("c"), as_bytes("v").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))).alias("block"))
        wider = hits(everyone.groupBy("block").cogroup(again.groupBy("block")).applyInPandas(rank, shape)).join(short.select("query_id"), "query_id", "left_semi")
        met = met.join(short.select("query_id"), "query_id", "left_anti").unionByName(wider)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").cast(kind).alias(id_col), "score")
