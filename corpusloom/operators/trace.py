"""Analytics over conversations and tool calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trim_history(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", budget: int = 14_000, min_keep: int = 5) -> DataFrame:
    """Messages left when, while a conversation is over `budget` characters and has more than `min_keep` messages, its third and fourth are taken out.

    The first two stay. The pair of messages 2j+2 and 2j+3 goes if, with all pairs before it gone, both
    conditions still hold; as both only ever turn false, each pair is judged by sums alone.
    """
    by = Window.partitionBy(conv_col)
    rows = df.withColumn("_i", F.row_number().over(by.orderBy(turn_col)) - 1).withColumn("_n", F.length(F.coalesce(text_col, F.lit(""))).cast("long"))
    rows = rows.withColumn("_total", F.sum("_n").over(by)).withColumn("_count", F.count("*").over(by))
    rows = rows.withColumn("_pair", F.floor((F.col("_i") - 2) / 2))
    before = F.coalesce(F.sum(F.when(F.col("_i") >= 2, F.col("_n"))).over(by.orderBy("_pair").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.when(F.col("_pair") >= 0, before).otherwise(F.lit(0))
    goes = (F.col("_i") >= 2) & (F.col("_total") - before > budget) & (F.col("_count") - 2 * F.col("_pair") > min_keep)
    return rows.withColumn("_goes", goes).where(~F.col("_goes")).select(*df.columns)


def repeat_islands(df: DataFrame, *, session: str, order: Sequence[str], signature: Column, out: str = "repeats") -> DataFrame:
    """How often the same signature has just come before without a break: 0 for the first of a run."""
    by = Window.partitionBy(session).orderBy(*order)
    rows = df.withColumn("_s", signature)
    rows = rows.withColumn("_new", (~F.col("_s").eqNullSafe(F.lag("_s").over(by)) | (F.row_number().over(by) == 1)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(by))
    run = Window.partitionBy(session, "_run").orderBy(*order)
    return rows.withColumn(out, (F.row_number().over(run) - 1).cast("long")).drop("_s", "_new", "_run")


def loop_guard(df: DataFrame, *, session: str, order: Sequence[str], tool: str, signature: Column, per_tool: int = 3, total: int = 7, warn: int = 1, force: int = 2) -> DataFrame:
    """`action` of each call: warn at a first repeat, force at a second, at a tool's third call or the seventh of all. Repeats use up no budget."""
    rows = repeat_islands(df, session=session, order=order, signature=signature, out="repeats")
    by = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fresh = (F.col("repeats") == 0).cast("int")
    rows = rows.withColumn("calls", F.sum(fresh).over(by)).withColumn("tool_calls", F.sum(fresh).over(Window.partitionBy(session, tool).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    action = F.when(F.col("repeats") >= force, "force").when(F.col("repeats") >= warn, "warn").when((F.col("tool_calls") >= per_tool) | (F.col("calls") >= total), "force").otherwise("run")
    return rows.withColumn("action", action)


def turn_pairs(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv_id, turn, instruction, response): each user turn that an assistant's follows."""
    by = Window.partitionBy(conv_col).orderBy(turn_col)
    rows = df.withColumn("_next", F.lead(F.struct("role", "text")).over(by))
    return rows.where("role = 'user' AND _next.role = 'assistant'").select(conv_col, turn_col, F.col("text").alias("instruction"), F.col("_next.text").alias("response"))
