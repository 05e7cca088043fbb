"""Connected components by alternating star contraction, on DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, rounds: int = 60, per_task: int = 100_000) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (u, v: integers) reaches.

    Large-star and small-star steps take turns until nothing changes, a logarithmic number of rounds in
    practice. Every step folds a node's neighbours into their minimum before the shuffle; a node of very
    many neighbours is split by the adaptive skew join. No link is collected to the driver.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tasks = min(partitions(edges.sparkSession), max(8, math.ceil(edges.count() / per_task)))
    edges = edges.coalesce(tasks)
    before = None
    for _ in range(rounds):
        # large star: neighbours above a node are linked to the least of it and its neighbours
        both = _both(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        # small star: neighbours below a node, and itself, are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct()
        edges = cut(small.coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
