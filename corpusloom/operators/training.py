"""Token ids to training arrays, schedules and sampling filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode(df: DataFrame, text_col: str, tokenizer_path: str, out: str = "ids", bound: int = 65_536) -> DataFrame:
    """Token ids by a tokenizer file, in Arrow batches. The vocabulary must fit `bound`, what 16-bit storage holds."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        if tokenizer.get_vocab_size() > bound:
            raise ValueError(f"a vocabulary of {tokenizer.get_vocab_size()} does not fit {bound}")
        for s in batches:
            yield pd.Series([x.ids for x in tokenizer.encode_batch([t or "" for t in s], add_special_tokens=False)])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<int>")(F.col(text_col)))


def sft_examples(df: DataFrame, prompt_ids: Column, response_ids: Column, block: int = 512, end_id: int = 0) -> DataFrame:
    """`ids` and `prompt_len`: prompt, response and the end mark; longer than a block, an example goes."""
    ids = F.concat(prompt_ids, response_ids, F.array(F.lit(end_id)))
    return df.withColumns({"ids": ids, "prompt_len": F.size(prompt_ids)}).where(F.size("ids") <= block)


def sft_batches(df: DataFrame, batch_col: str, pad_id: int = 0, ignore: int = -1) -> DataFrame:
    """`x` and `y`: ids without the last, ids shifted by one, the prompt's targets ignored, all padded to the batch's longest."""
    width = F.max(F.size("ids") - 1).over(Window.partitionBy(batch_col))
    rows = df.withColumn("_w", width)
    x = F.slice("ids", F.lit(1), F.size("ids") - 1)
    y = F.transform(F.slice("ids", F.lit(2), F.size("ids") - 1), lambda t, i: F.when(i < F.col("prompt_len") - 1, F.lit(ignore)).otherwise(t))
    pad = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.col("_w") - F.size("ids") + 1))
    return rows.withColumns({"x": pad(x, pad_id), "y": pad(y, ignore)}).drop("_w")


def causal_examples(df: DataFrame, prompt_ids: Column, full_ids: Column, max_len: int = 1024, ignore: int = -100) -> DataFrame:
    """`input_ids`, `labels`, `attention_mask`: cut to length, the prompt masked, nothing shifted; without any response left, an example goes."""
    ids = F.slice(full_ids, 1, max_len)
    rows = df.withColumns({"input_ids": ids, "_p": F.size(prompt_ids)}).where(F.col("_p") < F.size("input_ids"))
    labels = F.transform("input_ids", lambda t, i: F.when(i < F.col("_p"), F.lit(ignore)).otherwise(t))
    return rows.withColumns({"labels": labels, "attention_mask": F.array_repeat(F.lit(1), F.size("input_ids"))}).drop("_p")


@dataclass
class Schedule:
    """A learning rate: linear warm-up, then a cosine from `high` to `low`."""

    high: float
    low: float
    warmup: int
    decay: int


#: Rates and steps of pre-training; fine-tuning decays over all its steps.
PRETRAIN = Schedule(6e-4, 6e-5, 500, 20_000)
FINETUNE = Schedule(1e-4, 1e-5, 100, 2_000)


def lr_at(step: Column, s: Schedule) -> Column:
    share = (step - s.warmup) / float(max(1, s.decay - s.warmup))
    curve = s.low + 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share)) * (s.high - s.low)
    return F.when(step < s.warmup, s.high * (step + 1) / s.warmup).when(step >= s.decay, F.lit(s.low)).otherwise(curve)


def last_tokens(ids: Column, n: int) -> Column:
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def token_windows(df: DataFrame, id_col: str, ids_col: str, block: int, per_doc: int, seed: int = 42) -> DataFrame:
    """Windows of `block` ids and those one on, starting where a hash says; documents that hold none are left out."""
    n = F.size(ids_col) - block
    rows = df.where(n > 0).select(id_col, F.col(ids_col).alias("_ids"), F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))).alias("draw"))
    start = F.pmod(F.xxhash64(F.lit(seed), id_col, "draw"), F.size("_ids") - block).cast("int") + 1
    return rows.select(id_col, "draw", F.slice("_ids", start, block).alias("x"), F.slice("_ids", start + 1, block).alias("y"))


def sample_filter(logits: DataFrame, *, row: str = "row", token: str = "token", logit: str = "logit", seen: str | None = None, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, penalty: float = 1.0) -> DataFrame:
    """(row, token, p) of what may be sampled: repetition penalty, temperature, the k best with ties, and the nucleus, whose crossing token stays."""
    x = F.col(logit)
    if seen is not None and penalty != 1.0:
        x = F.when(F.col(seen), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x)
    rows = logits.select(row, token, (x / max(temperature, 1e-8)).alias("_x"))
    best = Window.partitionBy(row).orderBy(F.desc("_x"))
    if top_k is not None:
        rows = rows.withColumn("_r", F.rank().over(best)).where(F.col("_r") <= top_k).drop("_r")

    def softmax(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(row)
        e = F.exp(F.col("_x") - F.max("_x").over(w))
        return df.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")

    rows = softmax(rows)
    if top_p is not None:
        over = Window.partitionBy(row).orderBy(F.desc("_x"), token).rowsBetween(Window.unboundedPreceding, 0)
        rows = softmax(rows.withColumn("_c", F.sum("p").over(over) - F.col("p")).where(F.col("_c") <= top_p).drop("_c"))
    return rows.select(row, token, "p")
