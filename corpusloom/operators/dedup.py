"""Deduplication that keeps the first of equal rows in an explicit order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.text import normalise_key, strip


def row_key(*columns: Column | str) -> Column:
    """A 128-bit digest that tells rows apart by these columns, nulls told from texts."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def keep_first(df: DataFrame, key: Column | str, order: Sequence[Column | str]) -> DataFrame:
    """One row of each key, the first in `order`. Only the winners are found by an aggregate, which folds copies before the shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    packed = df.select(key.alias("_k"), by.alias("_o"), F.struct(*df.columns).alias("_r"))
    return packed.groupBy("_k").agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def dedup_paragraphs(
    df: DataFrame, *, id_col: str, text_col: str, order: Sequence[str], sep: str = "\n\n", min_key: int = 80,
    min_doc: int = 200, group_col: str | None = None, whole_doc_groups: Sequence[str] = (),
) -> DataFrame:
    """Documents less the long paragraphs that an earlier place holds; those left under `min_doc` characters go.

    Paragraphs whose normalised key is shorter than `min_key` always stay. Documents of `whole_doc_groups`
    are compared whole, under their text's own digest, as are paragraphs under theirs: one set of keys.
    Rows are told apart by `order`, id and text, so an id may stand in many rows; of equal places the one
    of the lesser digest is first, and rows equal in all of these are treated alike. The places of long
    paragraphs are checkpointed; a text is read once for them and once more to be cut.
    """
    whole = F.col(group_col).isin(list(whole_doc_groups)) if group_col and whole_doc_groups else F.lit(False)
    others = [c for c in order if c != id_col]
    rows = df.select(id_col, *others, whole.alias("_whole"), F.col(text_col).alias("_text"), row_key(id_col, *others, F.md5(text_col).alias("_t")).alias("_row"))
    parts = F.when(F.col("_whole"), F.array("_text")).otherwise(F.split("_text", sep))

    def keyed_part(part: Column, at: Column) -> Column:
        normal = normalise_key(part)
        key = F.when(F.col("_whole"), F.md5(part)).when(F.length(normal) >= min_key, F.md5(normal))
        return F.struct(at.alias("pos"), F.unhex(key).alias("key"))

    long_ones = F.filter(F.transform(parts, keyed_part), lambda p: p["key"].isNotNull())
    keyed = checkpointed(rows.select(id_col, *others, "_row", F.explode(long_ones).alias("_p")).select(id_col, *others, "_row", F.col("_p.pos").alias("_pos"), F.col("_p.key").alias("_key")))
    place = F.struct(*order, "_row", "_pos")
    firsts = keyed.groupBy("_key").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = keyed.join(firsts, "_key").where(~place.eqNullSafe(F.col("_first"))).groupBy("_row").agg(F.collect_set("_pos").alias("_gone"))
    split = F.split("_text", sep)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "_gone")
    left = F.when(F.col("_gone").isNull(), F.col("_text")).when(F.col("_whole"), F.lit("")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), sep))
    return rows.join(later, "_row", "left").select(id_col, strip(left).alias(text_col)).where(F.length(text_col) >= min_doc)


def capped_unique(
    df: DataFrame, caps: Mapping[str, int], *, source_col: str, id_col: str, text_col: str, size_col: str, prefix: int = 1000, known: DataFrame | None = None,
) -> DataFrame:
    """For each source in turn, its `cap` largest rows whose text beginning no chosen row has yet.

    A row beyond its source's cap is not chosen and so does not keep its copy in a later source out; hence
    sources are taken one after another. What is chosen is checkpointed after each, in keys and ids, at
    most the sum of the caps, so plans do not grow with the sources. Rows without a size come last; ties go
    by id, then by the text's digest, then by the row written out. An id that was chosen before, or is one
    of `known` (id), gets the row's number in its source behind it.
    """
    few = sum(caps.values()) <= 1_000_000
    small = F.broadcast if few else (lambda d: d)
    digest = lambda c: F.coalesce(F.md5(c), F.lit(""))
    keyed = df.select(source_col, id_col, size_col, digest(F.substring(text_col, 1, prefix)).alias("_k"), digest(text_col).alias("_d"))
    best = F.struct(F.col(size_col).isNull(), -F.col(size_col), F.col(id_col), F.col("_d"))
    largest = [F.col(size_col).desc_nulls_last(), F.col(id_col), F.col("_d")]
    chosen = None
    for turn, (source, cap) in enumerate(caps.items()):
        own = keyed.where(F.col(source_col) == source)
        if chosen is not None:
            own = own.join(small(chosen.select("_k")), "_k", "left_anti")
        own = own.groupBy("_k").agg(F.min_by(F.struct(id_col, size_col, "_d"), best).alias("_r")).select("_k", "_r.*")
        own = own.orderBy(*largest).limit(cap).select("_k", id_col, size_col, "_d", F.lit(source).alias(source_col), F.lit(turn).alias("_turn"))
        chosen = checkpointed(own if chosen is None else chosen.unionByName(own))
    if chosen is None:
        return df.limit(0)
    names = chosen.withColumn("_n", F.row_number().over(Window.partitionBy("_turn").orderBy(*largest)) - 1)
    names = names.withColumn("_again", F.row_number().over(Window.partitionBy(id_col).orderBy("_turn", "_n")) > 1)
    if known is not None:
        names = names.join(known.select(F.col(known.columns[0]).alias(id_col), F.lit(True).alias("_known")).distinct(), id_col, "left").withColumn("_again", F.col("_again") | F.col("_known").isNotNull())
    names = names.select(row_key(source_col, id_col, size_col, "_d").alias("_row"), "_again", "_n")
    rows = df.withColumn("_row", row_key(source_col, id_col, size_col, digest(text_col).alias("_d"))).join(small(names), "_row")
    whole = F.struct(*df.columns)
    rows = rows.groupBy("_row", "_again", "_n").agg(F.min_by(whole, F.to_json(whole)).alias("_r")).select("_r.*", "_again", "_n")
    if dict(df.dtypes)[id_col] == "string":
        rows = rows.withColumn(id_col, F.when(F.col("_again"), F.concat_ws("-", F.col(id_col), F.col("_n"))).otherwise(F.col(id_col)))
    return rows.select(*df.columns)


def unique_slugs(df: DataFrame, slug_col: str, order_col: str) -> DataFrame:
    """Slugs made unique: the second and later rows of one get their number behind it."""
    n = F.row_number().over(Window.partitionBy(slug_col).orderBy(order_col))
    return df.withColumn(slug_col, F.when(n == 1, F.col(slug_col)).otherwise(F.concat(F.col(slug_col), F.lit("-"), n.cast("string"))))
