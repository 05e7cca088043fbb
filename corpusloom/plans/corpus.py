"""End-to-end plans: corpus build, retrieval, and QA curation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.text import clean_by_kind, non_empty, normalise_key
from ..operators.budget import budget_prefix, hash_bucket, hash_order, split_by_chars
from ..operators.dedup import dedup_paragraphs, keep_first
from ..operators.reports import ADVANCED_SUFFIXES
from ..operators.retrieval import pack_chunks

#: Character budgets of the groups, in the order in which paragraphs are first met.
BUDGETS = {"wiki": 400_000_000, "tr-teknik": 20_000_000, "kod": 80_000_000, "guvenlik": 40_000_000}


def build_corpus(docs: DataFrame, budgets: Mapping[str, int] = BUDGETS, *, sep: str = "\n\n", whole_doc_groups: Sequence[str] = ("kod",), seed: int = 42) -> DataFrame:
    """(doc_id, text, split) of documents (grp, doc_id, text): trimmed to budgets, then cleared of repeated paragraphs, then split.

    The trim comes first, so a group may end under its budget. Rows that share an id are told apart by their
    group and text. What is left after the paragraphs is checkpointed, as the split reads it twice.
    """
    rank, target = None, None
    for i, (g, n) in enumerate(budgets.items()):
        rank = F.when(F.col("grp") == g, i) if rank is None else rank.when(F.col("grp") == g, i)
        target = F.when(F.col("grp") == g, n) if target is None else target.when(F.col("grp") == g, n)
    order = F.concat(F.coalesce(hash_order("doc_id", seed), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))
    rows = docs.where(F.col("grp").isin(list(budgets))).withColumns({"_o": order, "grp_rank": rank})
    sizes = rows.select("grp", "_o", F.length("text").cast("long").alias("_n"))
    ends = budget_prefix(sizes, F.col("_n"), target, "_o", hash_bucket(sizes, "_o"), ["grp"]).groupBy("grp").agg(F.max("_o").alias("_end"))
    trimmed = rows.join(F.broadcast(ends), "grp").where("_o <= _end")  # a row for each group
    clean = dedup_paragraphs(trimmed, id_col="doc_id", text_col="text", order=["grp_rank", "doc_id"], sep=sep, group_col="grp", whole_doc_groups=whole_doc_groups)
    return split_by_chars(checkpointed(clean), 0.01, "text", "doc_id", seed)


def build_chunks(docs: DataFrame, id_col: str, text_col: str, source: Column, sep: str = r"\n\s*\n", kind_col: str | None = None) -> DataFrame:
    """(chunk_id, source, chunk_pos, text) of documents cut into chunks; with `kind_col`, an extension, cleaned as that kind of text first."""
    text = F.col(text_col) if kind_col is None else clean_by_kind(F.col(text_col), F.col(kind_col))
    parts = docs.select(F.col(id_col).alias("_id"), source.alias("source"), F.posexplode(pack_chunks(text, sep=sep)).alias("chunk_pos", "text"))
    return parts.select(F.concat_ws("-", F.col("_id").cast("string"), F.col("chunk_pos").cast("string")).alias("chunk_id"), "source", "chunk_pos", "text")


def curate_pairs(pairs: DataFrame) -> DataFrame:
    """QA pairs (file, line, question, answer): named by their file, cleared of empty and repeated questions, tiered."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    domain = F.when(stem.startswith("guvenlik_"), "guvenlik").otherwise("yazilim")
    source = F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)
    kept = keep_first(pairs.where(non_empty(F.col("question"), F.col("answer"))), normalise_key(F.col("question")), ["file", "line"])
    named = kept.withColumns({"domain": domain, "source": source})
    return named.withColumn("tier", F.when(F.col("source").rlike("(" + "|".join(ADVANCED_SUFFIXES) + ")$"), "advanced").otherwise("basic"))
