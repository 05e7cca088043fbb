"""Counts, coverage and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import diacritic_count, diacritic_ratio, letter_count, non_empty, normalise_key
from .budget import range_bucket, running_before
from .dedup import keep_first

#: Suffixes of the advanced tier, and priorities by rank; an unknown one ranks as the middle.
ADVANCED_SUFFIXES = ("_tespit", "_derin", "_dfir", "_apro", "_damit")
PRIORITIES = ("yuksek", "orta", "dusuk")


def tally(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    return counted if top is None else counted.orderBy(F.desc("n"), key).limit(top)


def corpus_stats(df: DataFrame, group: str, text_col: str) -> DataFrame:
    """Documents and UTF-8 bytes of each group, and of all in a row without a group."""
    return df.rollup(group).agg(F.count("*").alias("docs"), F.sum(F.octet_length(text_col).cast("long")).alias("bytes"))


def quality_report(df: DataFrame, text_col: str, min_ratio: float = 0.02, min_chars: int = 4000) -> DataFrame:
    """One row: documents, those of a low letter ratio, short ones, and the mean ratio of the rest."""
    r = df.select(diacritic_ratio(F.col(text_col)).alias("r"), F.length(text_col).alias("n"))
    return r.agg(
        F.count("*").alias("docs"), F.count_if(F.col("r") < min_ratio).alias("suspects"), F.count_if(F.col("n") < min_chars).alias("short"),
        F.round(F.avg(F.when(F.col("r") >= min_ratio, F.col("r"))), 6).alias("mean_ratio"),
    )


def file_ratio(df: DataFrame, file_col: str, columns: Sequence[str], min_letters: int = 200, min_ratio: float = 0.02) -> DataFrame:
    """Files of many letters and a low ratio over all their values together."""
    add = lambda f: sum((f(F.coalesce(F.col(c), F.lit(""))) for c in columns), F.lit(0))
    sums = df.groupBy(file_col).agg(F.sum(add(letter_count)).alias("letters"), F.sum(add(diacritic_count)).alias("marked"))
    return sums.withColumn("ratio", F.round(F.col("marked") / F.col("letters"), 6)).where((F.col("letters") > min_letters) & (F.col("marked") / F.col("letters") < min_ratio))


def tier_share(df: DataFrame, source_col: str, suffixes: Sequence[str] = ADVANCED_SUFFIXES) -> DataFrame:
    """Rows of the advanced and the basic tier, by the source's ending, and their percentage."""
    advanced = F.lit(False)
    for s in suffixes:
        advanced = advanced | F.col(source_col).endswith(s)
    by = df.groupBy(F.when(advanced, "advanced").otherwise("basic").alias("tier")).agg(F.count("*").alias("n"))
    return by.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 3))


def priority_rank(c: Column) -> Column:
    out = None
    for i, p in enumerate(PRIORITIES):
        out = F.when(c == p, i) if out is None else out.when(c == p, i)
    return out.otherwise(1)


def priority_pivot(df: DataFrame, domain: str, priority: str) -> DataFrame:
    counted = df.groupBy(domain).pivot(priority, list(PRIORITIES)).agg(F.count(F.lit(1)))
    return counted.select(domain, *(F.coalesce(F.col(p), F.lit(0)).cast("long").alias(p) for p in PRIORITIES))


def gap_items(reports: DataFrame) -> DataFrame:
    """(domain, topic, reason, priority) of nested gap reports, whether wrapped in `result` or not."""
    found = F.coalesce(F.col("result.sonuclar"), F.col("sonuclar"))
    r = reports.select(F.explode(found).alias("r"))
    g = r.select(F.coalesce("r.domain", "r.alan").alias("domain"), F.explode("r.bosluklar").alias("g"))
    return g.select("domain", F.col("g.konu").alias("topic"), F.col("g.neden").alias("reason"), F.coalesce("g.oncelik", F.lit(PRIORITIES[1])).alias("priority"))


def validation_summary(df: DataFrame, score: str, clean: str, blocked: str) -> DataFrame:
    """One row: validated rows, blocked ones, and how many are unclean and weak (a score above 0 and under 3)."""
    return df.agg(
        F.count("*").alias("n"), F.sum(F.col(score)).cast("long").alias("score_sum"), F.count_if(F.col(blocked)).alias("n_blocked"),
        F.count_if(~F.col(clean)).alias("n_dirty"), F.count_if((F.col(score) > 0) & (F.col(score) < 3)).alias("n_weak"),
    )


def validation_lists(df: DataFrame, id_col: str, score: str, clean: str) -> DataFrame:
    """(kind, id): the ids of unclean ("dirty") and of weak rows, a row each, so a list may be as long as the table."""
    kinds = F.array(F.when(~F.col(clean), F.lit("dirty")), F.when((F.col(score) > 0) & (F.col(score) < 3), F.lit("weak")))
    return df.select(F.explode(F.array_compact(kinds)).alias("kind"), F.col(id_col).alias("id"))


def merge_report(df: DataFrame, question: str, answer: str, domain: str, order: Sequence[str]) -> DataFrame:
    """Valid and invalid pairs before deduplication, and pairs and bytes of each domain after it."""
    valid = non_empty(F.col(question), F.col(answer))
    before = df.agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))
    kept = keep_first(df.where(valid), normalise_key(F.col(question)), order)
    by = kept.groupBy(domain).agg(F.count("*").alias("pairs"), F.sum(F.octet_length(question) + F.octet_length(answer)).cast("long").alias("bytes"))
    return by.crossJoin(F.broadcast(before))


def ema(df: DataFrame, value: str, order: str, alpha: float = 0.1, partition: Sequence[str] = ()) -> DataFrame:
    """Exponential moving average of each partition's values in a numeric order, started at the first.

    A value's weight follows from how many come after it. These are counted in two levels, in
    order-preserving buckets and then within each, and the weighted values are summed up, so a series of
    any length is spread over many tasks, without a partition too.
    """
    rows = df.select(*partition, F.col(value).cast("double").alias("_value"), (-F.col(order)).alias("_down"))
    placed = running_before(rows, F.lit(1), "_down", range_bucket(rows, "_down"), partition, "_after")
    weighed = F.pow(F.lit(1.0 - alpha), F.col("_after")) * F.col("_value")
    rest = F.sum(alpha * weighed) + (1 - alpha) * F.max_by(weighed, "_after")  # the first has its weight whole
    return placed.groupBy(*partition).agg(rest.alias("ema"))


def corpus_files(spark: SparkSession, path: str, group: Column, text_col: str = "metin", pattern: str = "*.jsonl.gz") -> DataFrame:
    """(grp, files, docs, bytes, disk_bytes) of a corpus of JSON lines by groups of its files, and of all in a row without a group. `group` is over `name`, the file's."""
    name = F.element_at(F.split(F.col("path"), "/"), -1).alias("name")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select(name, F.col("length").alias("disk"))
    by_file = files.select(group.alias("grp"), F.lit(1).alias("files"), F.lit(0).alias("docs"), F.lit(0).cast("long").alias("bytes"), "disk")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    text = F.from_json("value", f"{text_col} string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    docs = lines.select(name, text.alias("r")).where("r._corrupt IS NULL")
    by_doc = docs.select(group.alias("grp"), F.lit(0).alias("files"), F.lit(1).alias("docs"), F.coalesce(F.octet_length(F.col("r")[text_col]), F.lit(0)).cast("long").alias("bytes"), F.lit(0).cast("long").alias("disk"))
    return by_file.unionByName(by_doc).rollup("grp").agg(F.sum("files").alias("files"), F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"), F.sum("disk").alias("disk_bytes"))


def chars_per_token(df: DataFrame, group: str, text_col: str, tokens: Column) -> DataFrame:
    return df.groupBy(group).agg(F.round(F.sum(F.length(text_col)) / F.sum(F.size(tokens)), 6).alias("chars_per_token"))
