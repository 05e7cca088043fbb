"""Chat formatting of reply trees.

Messages point at the message they answer. Self-joins enumerate the paths from roots to leaves: in each
round every message learns the ancestor twice as far away, with the sum of scores on the way, so a tree
of depth d takes log2(d) joins of ids. Branches are ranked by their mean score, and each chosen path is
formatted as one conversation.

The format marks every turn as `### role: text</turn>` and a line feed. In texts and roles a backslash
is doubled and one is put inside whatever would read as such a mark, so that no mark stands in a text
and `unescape` gives every text back. `loss` lists the spans, in code points, of the assistant's texts.
A conversation longer than `part_chars` comes in several parts, cut between turns, to be read in order.

Messages without an id take no part; a message whose parent is null or not there is a root; those on a
cycle, or below one, have no root and are on no path. An id that stands more than once is one message
with the least parent and the greatest score, and as many turns at its place, by role and text. Null
scores count as 0, null roles and texts as empty; ties of branches go by the leaf's id. Very long texts
are formatted whole. Only the named columns are read, so others cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut
from .words import slices

START, MIDDLE, END = "### ", ": ", "</turn>"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\").replace(END, "<\\" + END[1:])
    return re.sub("#(?=#)", r"#\\", text)


def escape_role(role: str) -> str:
    return escape(role).replace(MIDDLE, ":\\ ")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, or of a part of one."""
    at = 0
    while at < len(text):
        middle = text.index(MIDDLE, at)
        end = text.index(END, middle)
        yield unescape(text[at + len(START) : middle]), unescape(text[middle + len(MIDDLE) : end])
        at = end + len(END) + 1


def chat_paths(tree: DataFrame, *, id_col: str = "id", parent_col: str = "parent", score_col: str | None = "score", branches: int | None = 1) -> DataFrame:
    """(leaf, root, branch, score, depth, node): the messages on the `branches` best paths of each tree, or on all.

    Only ids move. A round joins the messages that have not reached their root with what is known of the
    ancestors they have reached; its results are checkpointed. Levels of a path are then filled in from the
    longest jump down, each by the messages alone that have so far to go.
    """
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    given = tree.select(F.col(id_col).alias("node"), F.col(parent_col).alias("up"), score.alias("total")).where("node IS NOT NULL")
    nodes = cut(given.groupBy("node").agg(F.min("up").alias("up"), F.max("total").alias("total")))
    ids = nodes.select(F.col("node").alias("up"))
    linked = cut(nodes.where("up IS NOT NULL").join(ids, "up", "left_semi").select("node", "up", F.col("node").alias("root"), "total", F.lit(1).cast("bigint").alias("n")))
    roots = nodes.join(linked.select("node"), "node", "left_anti").select("node", F.lit(None).cast(dict(nodes.dtypes)["up"]).alias("up"), F.col("node").alias("root"), "total", F.lit(1).cast("bigint").alias("n"))
    leaves = nodes.select("node").join(linked.select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    done, jumps = [cut(roots)], []
    rounds = math.ceil(math.log2(max(2, nodes.count()))) + 1
    going = linked
    while not going.isEmpty() and len(jumps) < rounds:  # longer than that only a cycle goes
        jumps.append(going.select("node", F.col("up").alias("far")))
        known = reduce(DataFrame.unionByName, [*done, going])
        above = known.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("total").alias("more"), F.col("n").alias("steps"))
        step = cut(going.select("node", "up", "total", "n").join(above, "up").select("node", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("steps")).alias("n")))
        done.append(step.where("up IS NULL"))
        going = step.where("up IS NOT NULL")
        if len(done) > 3:  # short plans
            done = [cut(reduce(DataFrame.unionByName, done))]
    whole = reduce(DataFrame.unionByName, done)
    paths = whole.join(leaves, "node", "left_semi").select(F.col("node").alias("leaf"), "root", (F.col("total") / F.col("n")).alias("score"), "n")
    if branches is None:
        paths = paths.withColumn("branch", F.lit(None).cast("int"))
    else:
        best = Window.partitionBy("root").orderBy(F.col("score").desc(), "leaf")
        paths = paths.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    out = paths.select("leaf", "root", "branch", "score", (F.col("n") - 1).alias("depth"), F.col("leaf").alias("node"), (F.col("n") - 1).alias("left"))
    out = cut(out)
    for k, level in reversed(list(enumerate(jumps))):
        # what is left above a message is under two steps of this length; only those with one take it
        both = F.array(F.struct("node", "depth"), F.struct(F.col("far").alias("node"), (F.col("depth") - (1 << k)).alias("depth")))
        long = out.where(F.col("left") >= 1 << k).join(level, "node").select("leaf", "root", "branch", "score", "left", F.posexplode(both).alias("i", "at"))
        long = long.select("leaf", "root", "branch", "score", "at.depth", "at.node", F.when(F.col("i") == 0, F.lit((1 << k) - 1)).otherwise(F.col("left") - (1 << k)).alias("left"))
        out = cut(out.where(F.col("left") < 1 << k).unionByName(long))
    return out.drop("left")


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, each behind its size, in batches of about `most`."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 100
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_paths(
    paths: DataFrame, messages: DataFrame, *, id_col: str = "id", role_col: str = "role", text_col: str = "text", name_col: str | None = None,
    assistant: str = "assistant", part_chars: int = 1 << 20,
) -> DataFrame:
    """(leaf, root, branch, score, name, part, n_turns, text, loss): each path of `chat_paths` as one conversation.

    `name` is what `name_col` says of the path's first message. Rows of a path stand together, parts in
    order. A path is streamed: a task holds one part of it, whatever its length.
    """
    name = F.col(name_col) if name_col else F.lit(None).cast("string")
    said = messages.select(F.col(id_col).alias("node"), name.alias("name"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = paths.join(said, "node").select("leaf", "root", "branch", "score", "name", "depth", "role", "text")
    rows = rows.repartition("leaf").sortWithinPartitions("leaf", "depth", "role", "text")
    schema = StructType([*rows.select("leaf", "root", "branch", "score", "name").schema.fields, *StructType.fromDDL("part int, n_turns int, text string, loss array<struct<start:int,stop:int>>").fields])
    arrow = to_arrow_schema(schema)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        head, part, pieces, size, loss = None, 0, [], 0, []
        for batch in slices(batches, "text"):
            for *of, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh = head is None or head[0] != of[0]
                if head is not None and (fresh or size >= part_chars):
                    yield size, (*head, part, len(pieces), "".join(pieces), loss)
                    part, pieces, size, loss = part + 1, [], 0, []
                if fresh:
                    head, part = of, 0
                before, body = START + escape_role(role) + MIDDLE, escape(text)
                if role == assistant:
                    loss.append({"start": size + len(before), "stop": size + len(before) + len(body)})
                pieces.append(f"{before}{body}{END}\n")
                size += len(pieces[-1])
        if head is not None:
            yield size, (*head, part, len(pieces), "".join(pieces), loss)

    return rows.mapInArrow(lambda batches: _batches(one_by_one(batches), arrow), schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(leaf, name, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from formatted conversations.

    Rows of a path must stand together, parts in order, as `format_paths` returns them; stored ones are
    to be repartitioned by `leaf` and sorted by (`leaf`, `part`) within partitions.
    """
    rows = formatted.select("leaf", "name", "text", "loss")
    schema = StructType([*rows.select("leaf", "name").schema.fields, *StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").fields])
    arrow = to_arrow_schema(schema)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        key = None

        def told() -> tuple[int, tuple]:
            return 200, (*key, n, said.hexdigest(), lost, learnt.hexdigest(), chars)

        for batch in slices(batches, "text"):
            for leaf, name, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or key[0] != leaf:
                    if key is not None:
                        yield told()
                    key, n, lost, chars, said, learnt = (leaf, name), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, turn in turns(text):
                    said.update(f"{role}\n{turn}\n".encode())
                    n += 1
                for span in loss:
                    there = unescape(text[span["start"] : span["stop"]])
                    lost += len(there)
                    learnt.update(there.encode())
                chars += len(text)
        if key is not None:
            yield told()

    return rows.mapInArrow(lambda batches: _batches(one_by_one(batches), arrow), schema)


def conversation_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, messages) of turns (conv_id, turn, role, text): each turn answers the one before it in its conversation.

    A turn's id is a 128-bit digest of its row; equal rows are one message that stands as often. Turns of one
    number follow each other by role and digest. Only ids and digests are sorted.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    digest = F.md5("text")
    rows = rows.withColumn("id", F.unhex(F.md5(F.to_json(F.struct("conv_id", "turn", "role", digest.alias("text")), {"ignoreNullFields": "false"}))))
    ids = rows.select("conv_id", "turn", "role", digest.alias("digest"), "id").distinct()
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "digest", "id")
    return ids.select("id", F.lag("id").over(before).alias("parent"), F.lit(0.0).alias("score")), rows
