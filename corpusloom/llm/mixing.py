"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is its source's target repetition rate:
the share wanted of the source, over the share it has. The number comes from inverting the Poisson
distribution at a point seeded by a hash of the document's id, so it is the same on every run and any
partitioning. Repeated documents are then shuffled globally by a second hash.

A null source is a source of its own. Null, empty and very long texts are documents like others. Rows
that repeat an id, or have none, get the same count each; equal keys of the order keep any order. Where
`docs` has a column `replica` or `mix_key`, in any case, the new one has underscores behind its name.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, partitions, quoted


_HIGH = 500.0


def seeded(seed: str, *parts: Column) -> Column:
    """A hash of the parts in [0, 1), of 32 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def poisson_inverse(u: Column, rate: Column, most: Column) -> Column:
    """The least n whose cumulative Poisson probability exceeds u; at most `most`. Above a rate of `_HIGH` the walk is on log-probabilities, as the first terms would underflow."""
    in_logs = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(F.lit(0).alias("n"), (-rate).alias("term"), F.exp(-rate).alias("cumulative")),
        lambda s, i: F.struct(
            F.when(s["cumulative"] <= u, i).otherwise(s["n"]).alias("n"),
            (s["term"] + F.log(rate / i)).alias("term"),
            (s["cumulative"] + F.exp(s["term"] + F.log(rate / i))).alias("cumulative"),
        ),
    )
    walked = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("term"), F.exp(-rate).alias("cumulative")),
        lambda s, i: F.struct(
            F.when(s["cumulative"] <= u, i).otherwise(s["n"]).alias("n"),
            (s["term"] * rate / i).alias("term"),
            (s["cumulative"] + s["term"] * rate / i).alias("cumulative"),
        ),
    )
    return F.when(rate > _HIGH, in_logs["n"]).otherwise(walked["n"])


def repetition_rates(docs: DataFrame, source: str, weights: dict[str | None, float] | None, temper: float, epochs: float) -> DataFrame:
    """(source, rate): wanted share over actual share, times `epochs`. Without `weights` a source is wanted by its own share to the power `temper`."""
    sizes = docs.groupBy(F.col(quoted(source)).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        wanted = sizes.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(temper)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "_key string, _w double")
        wanted = sizes.join(F.broadcast(named), F.col("_source").eqNullSafe(F.col("_key")), "left").drop("_key").fillna({"_w": 0.0})
    total = wanted.agg(F.sum("_n").alias("_all"), F.sum("_w").alias("_wanted"))
    return wanted.crossJoin(F.broadcast(total)).select("_source", (F.lit(epochs) * F.col("_all") * F.col("_w") / F.greatest(F.col("_wanted"), F.lit(1e-300)) / F.col("_n")).alias("_rate"))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None,
    temper: float = 0.5, epochs: float = 1.0, seed: str = "mix", most_rate: float | None = None, many_sources: int = 100_000, with_order: bool = True,
) -> DataFrame:
    """The columns of `docs`[, replica, mix_key, or these with underscores if `docs` has such], each document as often as drawn, in an order that mixes all sources.

    A source wanted more than `most_rate` times over raises, if that is given.
    Rates are broadcast if there are at most `many_sources` sources, which is counted; else they are
    joined by key. The texts are shuffled once, to the partition their key falls in; the mix is complete
    when partitions are read in any order.
    """
    rates = repetition_rates(docs, source, weights, temper, epochs)
    sources, highest = rates.agg(F.count("*"), F.max("_rate")).first()
    if most_rate is not None and (highest or 0.0) > most_rate:
        raise ValueError(f"a source would be repeated {highest:.3g} times")
    rate = F.col("_rate")
    most = F.greatest(F.lit(30), F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int"))  # the rest has less than a chance in 2**32
    packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("_row"), F.col(quoted(id_col)).cast("string").alias("_id"), F.col(quoted(source)).alias("_from"))
    joined = packed.join(F.broadcast(rates) if sources <= many_sources else rates, F.col("_from").eqNullSafe(F.col("_source")))
    times = poisson_inverse(seeded(seed, F.coalesce("_id", F.lit(""))), rate, most)
    repeated = joined.select("_row", "_id", times.alias("_times")).where("_times > 0").select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_replica"))
    key = F.md5(F.concat_ws(":", F.lit(seed + "-order"), F.coalesce("_id", F.lit("")), F.col("_replica").cast("string")))
    keyed = repeated.select("_row", "_replica", key.alias("_key"))
    mixed = keyed.repartition(partitions(docs.sparkSession), F.xxhash64("_key")).sortWithinPartitions("_key")
    return mixed.select("_row.*", *([F.col("_replica").alias(free_name(docs, "replica")), F.col("_key").alias(free_name(docs, "mix_key"))] if with_order else []))


def sql(temper: float = 0.5, seed: str = "mix", most: int = 30) -> str:
    """DuckDB SQL for the query over `documents`."""
    return f"""
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temper}) AS w FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) * w / (SELECT sum(w) FROM sizes) / n AS rate FROM sizes),
drawn AS (SELECT d.*, r.rate, ('0x' || substr(md5('{seed}:' || d.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS u
          FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
steps AS (SELECT i::INTEGER AS i, 1.0::DOUBLE / factorial(i::INTEGER)::DOUBLE AS f FROM range(0, {most} + 1) t(i)),
cumulative AS (SELECT s.source, s.i, sum(s.p) OVER (PARTITION BY s.source ORDER BY s.i) AS c
               FROM (SELECT r.source, i, exp(-r.rate) * pow(r.rate, i) * f AS p FROM rates r, steps) s),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cumulative c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS times FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, replica::INTEGER AS replica, md5('{seed}-order:' || doc_id::VARCHAR || ':' || replica::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(1, least(times, {most}) + 1)) AS replica FROM counted) t"""
