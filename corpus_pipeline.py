"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes all that its predecessor kept, as written, and its decisions take effect. All but the
last return the columns of `documents`. Rows are judged and masked by their own text, whatever their id;
null and empty texts fail the quality rules, very long ones are taken whole, equal rows are one after the
near duplicates; ties go as each operator says. The stages read `documents`' columns by name; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import bpe_encode
from corpusloom.llm.common import cut, shared_folder
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.ngram_join import ngram_components
from corpusloom.llm.quality_rules import Rules
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.secrets import mask_live, scan_secrets
from corpusloom.llm.sketch import split_by_keys


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by its own text."""
    return Rules(docs).kept()


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates, once: those whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked.

    A row goes only if its own text is a repeat: of rows of a group that share its least id the one of the
    least text by digest stays, of equal texts the least row. Rows that share an id and are of different
    groups are judged apart. Rows without an id or without words link with nothing, and stay.
    """
    found = cut(ngram_components(docs, k=5, percent=80, by_text=True).where("doc_id IS NOT NULL AND n_shingles > 0"))
    gone = found.where("doc_id <> component_id").select("doc_id", "text_md5", F.lit(False).alias("stays"))
    texts = found.where("doc_id = component_id").groupBy("root", "doc_id", "text_md5").agg(F.count("*").alias("n"))
    several = texts.groupBy("root", "doc_id").agg(F.min("text_md5").alias("least"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    first = texts.join(several, ["root", "doc_id"]).select("doc_id", "text_md5", (F.col("text_md5") == F.col("least")).alias("stays"))
    key = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text_md5"))
    touched = cut(gone.unionByName(first).select(key.alias("key"), "stays").distinct())  # few beside the rest, which is not shuffled
    own = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5("text"))
    sure, maybe = split_by_keys(docs, own, touched.select("key"))
    maybe = maybe.withColumn("key", own)
    alone = maybe.join(touched.select("key").hint("shuffle_hash"), "key", "left_anti").select(docs.columns)
    repeated = maybe.join(touched.where("stays").select("key").hint("shuffle_hash"), "key", "left_semi")
    row = F.struct(*docs.columns)
    firsts = repeated.groupBy("key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return sure.unionByName(alone).unionByName(firsts.select(docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials replaced."""
    return mask_live(docs, scan_secrets(docs, owner="source", repository="concat_ws('/', source, lang)"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in a global shuffle."""
    return mix_sources(docs, with_order=False)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return bpe_encode(docs, vocabulary())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources to target weights", mixing), ("BPE encoding and decoding", encoding)]

#: SQL expresses neither the robust estimates nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each written to the shared folder and read again by the next, which removes it. What stays there is the result, a row of digests for each document."""
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            remove(spark, f"{top}/{k - 1}")
    return docs
