"""Chunking, BM25, cosine, blending, reranking and context rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from .budget import top_k


def pack_chunks(text: Column, min_len: int = 200, max_len: int = 1400, sep: str = r"\n\s*\n", joiner: str = "\n\n") -> Column:
    """Blocks packed greedily: a block joins the buffer while both lengths stay under `max_len`; a flushed buffer under `min_len` is discarded, and a long block is never split."""
    blocks = F.filter(F.transform(F.split(text, sep), strip), lambda b: b != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def flush(s: Column) -> Column:
        return F.when(F.length(s["buf"]) >= min_len, F.array_append(s["done"], s["buf"])).otherwise(s["done"])

    def step(s: Column, b: Column) -> Column:
        joined = F.when(s["buf"] == "", b).otherwise(F.concat(s["buf"], F.lit(joiner), b))
        return F.when(F.length(s["buf"]) + F.length(b) < max_len, F.struct(s["done"].alias("done"), joined.alias("buf"))).otherwise(F.struct(flush(s).alias("done"), b.alias("buf")))

    return F.aggregate(blocks, empty, step, flush)


@dataclass
class Bm25Index:
    """Postings and the statistics that scores need."""

    postings: DataFrame  # term, id, tf
    lengths: DataFrame  # id, dl
    terms: DataFrame  # term, df, idf
    n: int
    average: float


def bm25_index(df: DataFrame, id_col: str, text_col: str, epsilon: float = 0.25) -> Bm25Index:
    """The index of every row. Terms of a negative weight get `epsilon` of the mean weight of all terms, negative ones included."""
    words = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    lengths = words.select("id", F.size("w").alias("dl"))
    n, average = lengths.agg(F.count("*"), F.avg("dl")).first()
    postings = words.select("id", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    raw = postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(postings, lengths, terms, n, average or 1.0)


def bm25_scores(index: Bm25Index, query: Sequence[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of rows that hold a query word; a word repeated in the query counts again. Of a stored index only the query words' postings are read."""
    spark = index.postings.sparkSession
    times: dict[str, int] = {}
    for w in query:
        times[w] = times.get(w, 0) + 1
    wanted = F.broadcast(spark.createDataFrame(list(times.items()), "term string, times int"))
    of_query = F.col("term").isin(list(times))
    weights = F.broadcast(index.terms.where(of_query).join(wanted, "term").select("term", "idf", "times"))  # one row for each query word
    hits = index.postings.where(of_query).join(weights, "term").join(index.lengths, "id")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(index.average))))
    return hits.groupBy("id").agg(F.sum(part).alias("score"))


def write_index(index: Bm25Index, path: str) -> None:
    """The index as Parquet: postings and terms sorted by term, so that a search reads the row groups of its words."""
    index.postings.sort("term").write.parquet(f"{path}/postings")
    index.terms.sort("term").write.parquet(f"{path}/terms")
    index.lengths.write.parquet(f"{path}/lengths")
    index.postings.sparkSession.createDataFrame([(index.n, float(index.average))], "n bigint, average double").write.parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> Bm25Index:
    n, average = spark.read.parquet(f"{path}/meta").first()
    return Bm25Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "terms")), n, average)


def bm25_direct(df: DataFrame, id_col: str, text_col: str, query: Sequence[str], epsilon: float = 0.25, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of rows that hold a query word, without an index.

    One pass counts the terms of all rows, as the mean weight that negative ones fall back to is over all
    of them; a second scores each row where it stands. Words are not shuffled, their counts are.
    """
    times: dict[str, int] = {}
    for w in query:
        times[w] = times.get(w, 0) + 1
    words = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    n, average = words.agg(F.count("*"), F.avg(F.size("w"))).first()
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    mean, *found = terms.agg(F.avg(raw), *(F.max(F.when(F.col("term") == t, raw)) for t in times)).first()
    score, any_hit = F.lit(0.0), F.lit(False)
    for (t, m), weight in zip(times.items(), found, strict=True):
        if weight is not None:
            tf = F.size("w") - F.size(F.array_remove("w", t))
            idf = float(epsilon * mean if weight < 0 else weight)
            score = score + m * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("w") / F.lit(float(average or 1.0))))
            any_hit = any_hit | F.array_contains("w", t)
    return words.where(any_hit).select("id", score.alias("score"))


def bm25_search(df: DataFrame, id_col: str, text_col: str, query: Sequence[str], k: int, epsilon: float = 0.25) -> DataFrame:
    """The k best rows for one query."""
    return top_k(bm25_direct(df, id_col, text_col, query, epsilon).withColumn("score", F.round("score", 6)), "score", "id", k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(df: DataFrame, vector_col: str, query: Sequence[float]) -> DataFrame:
    """Dot products with one vector: cosines, as stored vectors have unit length."""
    return df.withColumn("score", dot(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])))


def minmax(df: DataFrame, columns: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Columns scaled to 0 to 1; 0 where all are equal. The bounds come from one aggregate, not from a window over all rows."""
    bounds = df.groupBy(*partition).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    joined = df.join(F.broadcast(bounds) if not partition else bounds, list(partition)) if partition else df.crossJoin(F.broadcast(bounds))
    scaled = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.lit(0.0)) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def hybrid(df: DataFrame, semantic: str, lexical: str, w_semantic: float = 0.68, w_lexical: float = 0.32) -> DataFrame:
    """`hybrid` of scaled semantic and lexical scores; rows without a lexical match count as 0."""
    filled = df.withColumns({semantic: F.coalesce(semantic, F.lit(0.0)), lexical: F.coalesce(lexical, F.lit(0.0))})
    return minmax(filled, [semantic, lexical]).withColumn("hybrid", w_semantic * F.col(semantic) + w_lexical * F.col(lexical))


def rerank(df: DataFrame, scorer: Column | Callable[[DataFrame], Column], hybrid_col: str = "hybrid", w_rerank: float = 0.35, w_hybrid: float = 0.65) -> DataFrame:
    """`final` of the candidates' scaled reranker and hybrid scores; the scorer is any column, a pandas UDF over a model included."""
    scored = df.withColumn("rr", scorer if isinstance(scorer, Column) else scorer(df))
    return minmax(scored, ["rr", hybrid_col]).withColumn("final", w_rerank * F.col("rr") + w_hybrid * F.col(hybrid_col))


def search(df: DataFrame, *, semantic: str | None, lexical: str, id_col: str, k: int = 5, candidates: int = 30, scorer: Column | None = None) -> DataFrame:
    """What the capabilities at hand allow: lexical alone, hybrid, or hybrid candidates reranked."""
    if semantic is None:
        return top_k(df, lexical, id_col, k)
    mixed = hybrid(df, semantic, lexical)
    if scorer is None:
        return top_k(mixed, "hybrid", id_col, k)
    few = top_k(mixed, "hybrid", id_col, max(k, candidates)).drop("rank")
    return top_k(rerank(few, scorer), "final", id_col, k)


def render_context(df: DataFrame, source_col: str, text_col: str, rank_col: str = "rank", max_chars: int = 650, none: str = "(no match)") -> DataFrame:
    """One row: the hits in order, each under its source."""
    part = F.concat(F.lit("### Kaynak: "), F.col(source_col), F.lit("\n"), F.substring(text_col, 1, max_chars))
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), part.alias("p"))))
    text = F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n")
    return df.agg(F.when(F.count("*") > 0, text).otherwise(F.lit(none)).alias("context"))


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], prefix: str = "passage: ", max_chars: int = 512) -> DataFrame:
    """`embedding` by any model of batches of texts, in Arrow batches. The model is made where it runs if it is a class."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = model() if isinstance(model, type) else model
        for s in batches:
            yield pd.Series(made([prefix + (t or "")[:max_chars] for t in s]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text_col)))


def embed_query(query: str, model: Callable[[list[str]], list[list[float]]], prefix: str = "query: ", max_chars: int = 512) -> list[float]:
    """A query's vector by the model that made the passages' ones, of unit length."""
    made = model() if isinstance(model, type) else model
    vector = [float(x) for x in made([prefix + query[:max_chars]])[0]]
    length = max(sum(x * x for x in vector) ** 0.5, 1e-9)
    return [x / length for x in vector]


def window_per_query(df: DataFrame, query_col: str, score: str, id_col: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc(score), id_col))).where(F.col("rank") <= k)
