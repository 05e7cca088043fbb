"""The queries of this subpackage, each applying one operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, url_filter
from .alignment import ByteBpe, PieceBpe, align
from .bpe import bpe_encode
from .common import table
from .cotraining import classify_quality
from .nearest import nearest
from .ngram_join import ngram_components
from .quality_rules import quality_rules
from .reply_trees import chat_paths, conversation_tree, format_paths, read_back
from .secrets import scan_secrets
from .substring_dedup import substring_dedup
from .toxicity import score_toxicity
from .vector_codes import compress_vectors


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(url_filter.page_captures(pages), url_filter.page_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), vocabulary())


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), owner="source", repository="concat_ws('/', source, lang)")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], given.schema)
    tree, messages = conversation_tree(given.unionByName(more))
    formatted = format_paths(chat_paths(tree), messages, name_col="conv_id")
    return read_back(formatted).select(F.col("name").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = functools.partial(ByteBpe, vocabulary("byte_bpe_50k.json")), functools.partial(PieceBpe, vocabulary("piece_bpe_32k.model"))
    return align(table(spark, sf_dir, "documents"), one, other)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_ngram_join": op3_ngram_join,
        "op4_mixing": op4_mixing,
        "op5_url_filter": op5_url_filter,
        "op6_quality": op6_quality,
        "op7_toxicity": op7_toxicity,
        "op8_bpe": op8_bpe,
        "op9_nearest": op9_nearest,
        "op10_secrets": op10_secrets,
        "op11_vector_codes": op11_vector_codes,
        "op12_chat_format": op12_chat_format,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.sql(), "op5_url_filter": url_filter.SQL}
