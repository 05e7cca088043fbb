"""Budgets, splits, shards and top-k.

Running sums over a whole table are taken in two levels: sums of order-preserving buckets, then within
each bucket. No task holds more than a bucket, where a plain window without a partition would hold all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int | str) -> Column:
    """An order that is random, yet the same on every run and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_bucket(df: DataFrame, order: str) -> Column:
    """The first hexadecimal digits of a hash order: 256 buckets, and more where the session has more partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.substring(order, 1, max(2, -(-(partitions - 1).bit_length() // 4)))


def range_bucket(df: DataFrame, order: str, buckets: int = 256, per_bucket: int = 2000) -> Column:
    """Numbers of steps of about equal numbers of rows of a numeric order; crowded values stay in one.

    There are `buckets`, or as many as the session's partitions if that is more, but no more than one for
    each `per_bucket` rows. Their bounds come from a sample of about 50 rows for each, so the table is read
    for its count and the sample, not sorted.
    """
    rows = df.count()
    buckets = min(max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), rows // per_bucket + 1)
    if buckets == 1:
        return F.lit(0)
    some = df.select(F.col(order).alias("o")).where("o IS NOT NULL").sample(min(1.0, 50 * buckets / rows), 7)
    drawn = sorted(r.o for r in some.collect())  # about 50 numbers a bucket
    bounds = sorted({drawn[len(drawn) * i // buckets] for i in range(1, buckets)}) if drawn else []

    def place(low: int, high: int) -> Column:  # a search by halves, as an expression
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(order) <= bounds[middle], place(low, middle)).otherwise(place(middle + 1, high))

    return place(0, len(bounds))


def running_before(df: DataFrame, value: Column, order: str, bucket: Column, partition: Sequence[str] = (), out: str = "before") -> DataFrame:
    """`df` with the sum of `value` over all rows that come before, within a partition."""
    keys = list(partition)
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    same = [rows[k].eqNullSafe(sums[k]) for k in [*keys, "_b"]]
    joined = rows.join(sums, same)
    return joined.select(*[rows[c] for c in df.columns], (F.col("_in") + F.col("_base")).alias(out))


def budget_prefix(df: DataFrame, size: Column, target: Column | int, order: str, bucket: Column, partition: Sequence[str] = ()) -> DataFrame:
    """Rows in order while the sum before them is under the target; the row that crosses it is kept."""
    target = F.lit(target) if not isinstance(target, Column) else target
    return running_before(df, size, order, bucket, partition, "_before").where(F.col("_before") < target).drop("_before")


def split_by_chars(df: DataFrame, fraction: float, text_col: str, id_col: str, seed: int = 42) -> DataFrame:
    """`split`: val for the first rows in hash order until they hold the fraction of all characters, train for the rest.

    Orders and lengths alone are summed up; the order at which val ends then tells every row its side, so
    nothing is joined. Rows that share an id are told apart by their text.
    """
    order = F.concat(F.coalesce(hash_order(id_col, seed), F.lit("")), F.lit(":"), F.coalesce(F.md5(text_col), F.lit("")))
    rows = df.select(F.length(text_col).cast("long").alias("_n"), order.alias("_o"))
    total = rows.agg(F.sum("_n")).first()[0] or 0
    placed = running_before(rows, F.col("_n"), "_o", hash_bucket(rows, "_o"), out="_before")
    last = placed.where(F.col("_before") < int(total * fraction)).agg(F.max("_o")).first()[0]
    return df.withColumn("split", F.when(order <= F.lit(last or ""), "val").otherwise("train"))


def split_by_rows(df: DataFrame, fraction: float, order: Column) -> DataFrame:
    """`split` by number of rows: at least one row is val."""
    rows = df.withColumn("_o", order)
    n = rows.count()
    placed = running_before(rows, F.lit(1), "_o", hash_bucket(rows, "_o"), out="_before")
    return placed.withColumn("split", F.when(F.col("_before") < max(1, int(n * fraction)), "val").otherwise("train")).drop("_o", "_before")


def assign_shards(df: DataFrame, order: str, bucket: Column, per_shard: int = 20_000, name: str = "korpus_") -> DataFrame:
    """`shard` (from 1) and `shard_name` of each row, in order. An exact multiple leaves no empty last shard."""
    placed = running_before(df, F.lit(1), order, bucket, out="_before")
    shard = (F.floor(F.col("_before") / per_shard) + 1).cast("long")
    return placed.withColumn("shard", shard).withColumn("shard_name", F.concat(F.lit(name), F.lpad(shard.cast("string"), 4, "0"))).drop("_before")


def manifest(df: DataFrame, source_col: str, text_col: str, per_shard: int = 20_000) -> DataFrame:
    """Totals of a corpus, and its sources with their numbers."""
    by = df.groupBy(source_col).agg(F.count("*").alias("n"), F.sum(F.length(text_col)).alias("chars"))
    named = F.array_sort(F.collect_list(F.concat_ws("=", F.col(source_col), F.col("n"))))
    return by.agg(
        F.sum("n").alias("total_docs"), F.round(F.sum("chars") / 1e9, 3).alias("total_gb"),
        F.ceil(F.sum("n") / per_shard).cast("long").alias("shards"), F.array_join(named, ",").alias("sources"),
    )


def hash_sample(df: DataFrame, id_col: str, seed: int | str, n: int) -> DataFrame:
    return df.withColumn("_o", hash_order(id_col, seed)).orderBy("_o", id_col).limit(n).drop("_o")


def top_k(df: DataFrame, score: str, id_col: str, k: int, partition: Sequence[str] = ()) -> DataFrame:
    """The k best rows, ties by id, with `rank`. Per partition this is a window whose limit runs before the shuffle."""
    best = [F.col(score).desc(), F.col(id_col)]
    if not partition:
        few = df.orderBy(*best).limit(k)
        return few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*best)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*best))).where(F.col("rank") <= k)


def page(df: DataFrame, order: Sequence[str], index: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(index * size).limit(size)
