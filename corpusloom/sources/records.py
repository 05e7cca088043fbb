"""Parquet, JSON lines, XML, STIX, vulnerability records and Markdown trees as text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import clean_markdown, decode_leniently, lines_of, strip

CVE_SCHEMA = (
    "cveMetadata struct<cveId:string,state:string>, containers struct<cna:struct<"
    "descriptions:array<struct<lang:string,value:string>>,problemTypes:array<struct<descriptions:array<struct<cweId:string,description:string>>>>,"
    "metrics:array<map<string,string>>,affected:array<struct<vendor:string,product:string>>,references:array<struct<url:string>>>>"
)
STIX_SCHEMA = "objects array<struct<type:string,name:string,description:string,x_mitre_detection:string>>"


def read_parquet_text(spark: SparkSession, path: str, text_col: str = "text", min_chars: int = 300) -> DataFrame:
    """The stripped texts of at least `min_chars`; only this column is read."""
    return spark.read.parquet(path).select(strip(F.col(text_col)).alias("text")).where(F.length("text") >= min_chars)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, keep_corrupt: bool = False) -> DataFrame:
    """JSON lines, gzip too. Bad lines are dropped, or kept with what they hold in `_corrupt`."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    wide = StructType([*schema.fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return parsed if keep_corrupt else parsed.where("_corrupt IS NULL").drop("_corrupt")


def read_markdown_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, slug, text) of all Markdown files below `path`; the category is the folder's name."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(F.col("_metadata.file_path").alias("path"), F.element_at(parts, -2).alias("category"), F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("slug"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, max_bytes: int = 2_000_000, skip: tuple[str, ...] = (".venv", "__pycache__", ".git", "/models/")) -> DataFrame:
    """(path, line_no, line) of the text files below `path` that are not too large; bytes that are no UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    for s in skip:
        files = files.where(~F.col("path").contains(s))
    lines = lines_of(decode_leniently(F.col("content")))
    return files.select("path", F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def first_english(descriptions: Column) -> Column:
    """The first English description, else the first that has a value."""
    full = F.filter(descriptions, lambda d: F.length(F.coalesce(d["value"], F.lit(""))) > 0)
    english = F.filter(full, lambda d: d["lang"].startswith("en"))
    return F.coalesce(F.get(english, F.lit(0))["value"], F.get(full, F.lit(0))["value"], F.lit(""))


def _joined(*parts: Column) -> Column:
    return strip(F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), " "))


def render_cve(records: DataFrame, name: str = "cveMetadata.cveId") -> DataFrame:
    """(id, text) of vulnerability records that are not rejected and are described in 20 characters or more.

    Weakness labels are distinct in first-seen order; of each metric the first kind with a score counts;
    the first five products are taken and then cleared of "n/a"; references are cleared and then the first four taken.
    """
    cna, meta = F.col("containers.cna"), F.col("cveMetadata")
    about = first_english(cna["descriptions"])
    empty = F.array().cast("array<string>")
    weak = F.flatten(F.transform(cna["problemTypes"], lambda p: F.transform(F.coalesce(p["descriptions"], F.array()), lambda d: _joined(d["cweId"], d["description"]))))
    weak = F.array_distinct(F.filter(F.coalesce(weak, empty), lambda x: x != ""))
    scored = F.transform(F.coalesce(cna["metrics"], F.array()), lambda m: F.get(F.filter(F.map_entries(m), lambda e: F.get_json_object(e["value"], "$.baseScore").isNotNull()), F.lit(0)))
    metric = F.transform(F.filter(scored, lambda e: e.isNotNull()), lambda e: strip(F.concat(F.lit("CVSS ("), e["key"], F.lit("): "), F.get_json_object(e["value"], "$.baseScore"), F.lit(" "), F.coalesce(F.get_json_object(e["value"], "$.baseSeverity"), F.lit("")))))
    clear = lambda x: F.when(x != "n/a", x)
    hit = F.array_distinct(F.filter(F.transform(F.slice(F.coalesce(cna["affected"], F.array()), 1, 5), lambda a: _joined(clear(a["vendor"]), clear(a["product"]))), lambda x: x != ""))
    refs = F.slice(F.filter(F.transform(F.coalesce(cna["references"], F.array()), lambda r: r["url"]), lambda u: F.length(F.coalesce(u, F.lit(""))) > 0), 1, 4)
    line = lambda name, items, by: F.when(F.size(items) > 0, F.array(F.concat(F.lit(name), F.array_join(items, by)))).otherwise(empty)
    head = F.array(F.concat(meta["cveId"], F.lit(" ("), meta["state"], F.lit(")")), F.lit(""), about)
    text = F.array_join(F.concat(head, line("Zafiyet turu (CWE): ", weak, "; "), metric, line("Etkilenen: ", hit, "; "), line("Referanslar: ", refs, " ")), "\n")
    return records.where((F.coalesce(meta["state"], F.lit("")) != "REJECTED") & (F.length(about) >= 20)).select(F.col(name).alias("id"), text.alias("text"))


def render_stix(bundles: DataFrame, variant: str = "any") -> DataFrame:
    """Texts of described objects. "any": each of 100 characters or more, detection added. "attack-pattern": techniques of 200 or more, cut at 2800."""
    o = bundles.select(F.explode("objects").alias("o")).select("o.*")
    if variant == "any":
        o = o.where(F.length("description") >= 100)
        name = F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")"))
        found = F.when(F.length("x_mitre_detection") > 0, F.concat(F.lit("Detection: "), clean_markdown(F.col("x_mitre_detection"))))
        return o.select(F.concat_ws("\n", name, clean_markdown(F.col("description")), found).alias("text"))
    o = o.where("type = 'attack-pattern'").where(F.length("description") >= 200)
    return o.select(F.concat_ws("\n", F.coalesce("name", F.lit("")), F.substring(clean_markdown(F.col("description"), "retrieve"), 1, 2800)).alias("text"))


def render_cwe(spark: SparkSession, path: str, min_chars: int = 200) -> DataFrame:
    """(id, text) of the weaknesses of an XML catalogue: name, description cut at 1100, first mitigations cut at 600.

    Explicit string fields give each element's inner XML in order, mixed content too; tags are stripped after.
    """
    schema = "_ID string, _Name string, Description string, Extended_Description string, Potential_Mitigations string"
    rows = spark.read.format("xml").option("rowTag", "Weakness").schema(schema).load(path)
    plain = lambda c: strip(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"<[^>]+>", " "), r"\s+", " "))
    about = F.substring(strip(F.concat_ws(" ", plain("Description"), plain("Extended_Description"))), 1, 1100)
    fix = F.substring(plain("Potential_Mitigations"), 1, 600)
    text = F.concat_ws("\n", F.concat(F.lit("CWE-"), F.col("_ID"), F.lit(": "), F.col("_Name")), about, F.when(fix != "", F.concat(F.lit("Mitigation: "), fix)))
    return rows.where("_ID IS NOT NULL AND _Name IS NOT NULL").select(F.col("_ID").alias("id"), text.alias("text")).where(F.length("text") >= min_chars)


def read_parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a folder of Parquet files; of those below a folder named "train" alone, if there are any."""
    every = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(path)
    train = every.where(F.col("_metadata.file_path").contains("/train/"))
    return train if any("/train/" in f for f in every.inputFiles()) else every
