"""Quality rules by robust multivariate outliers.

Each document gives a vector of transformed text statistics. For every language and source a minimum
covariance determinant (MCD) estimate of location and scatter is made, and documents whose Mahalanobis
distance from it is too large are rejected, besides those that fail the plain base rules.

The estimate is distributed: a group's rows are dealt into blocks of bounded size, concentration steps
run in each block, the blocks' estimates are pooled, and one reweighting pass over all rows gives the
final estimate. Groups too small for an estimate share one for their language, and languages too small
for one take that of all rows; where all rows are too few (under twelve), the base rules alone judge.

Null and empty texts have zero counts and fail the base rules; very long texts are measured whole. Null
languages and sources form groups of their own. Rows of a null id are judged as any. Repeated rows each
count and each return a row; equal distances are judged alike, so there are no ties. Only id, text and
group columns are read, so other names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, quoted
from .words import Words, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:\"'()[]{}=+/\\~^_@`")] = True
_SPACE = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What is compared: transformed statistics, and the least standard deviation granted to each, so that
#: a statistic that is the same in nearly all documents (no symbols, say) does not reject the rest.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "marks")
FLOORS = np.array([0.10, 0.045, 0.15, 0.15, 0.05, 0.06])


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each two neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, whole, and those that only the vector uses."""
    w = Words(texts)
    at = w.offsets
    chars = (w.data & 0xC0) != 0x80
    space = np.isin(w.data, np.frombuffer(_SPACE.encode(), np.uint8))
    out = {
        "n_words": w.count,
        "word_chars": per_text(chars & ~space, at),
        "n_symbols": per_text(_SYMBOL[w.data], at),
        "upper": per_text(_UPPER[w.data], at),
        "marks": per_text(_MARK[w.data], at),
    }
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(w.texts.to_pylist()):
        kept = [x for x in text.split("\n") if x.strip(_SPACE)]
        lines[i], dup[i] = len(kept), len(kept) - len(set(kept))
    out |= {"n_lines": lines, "n_dup_lines": dup}
    hashes, where = w.windows(w.hashes(), 3)
    covered = np.zeros(len(w.starts) + 1, np.int64)
    if len(where):
        doc, value = w.doc[where], hashes[where]
        order = np.lexsort((value, doc))
        d, v = doc[order], value[order]
        same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
        twice = np.zeros(len(d), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = where[order[twice]]
        for j in range(3):
            covered[hit + j] = 1
    out["n_repeat_words"] = per_text(covered[:-1] > 0, w.first_word)
    return out


def vectors(s: dict[str, np.ndarray]) -> np.ndarray:
    """The transformed statistics: a logarithm of the mean word length, and square roots of shares, which even out their spread."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack(
        [
            np.log(chars / words),
            np.sqrt(s["n_symbols"] / chars),
            s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
            s["n_repeat_words"] / words,
            np.sqrt(s["upper"] / chars),
            np.sqrt(s["marks"] / chars),
        ],
        axis=1,
    )


def robust_start(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), FLOORS)
    return centre, np.diag(spread**2)


def distances(x: np.ndarray, centre: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances, under the scatter with the floors added."""
    d = x - centre
    return np.einsum("ij,ij->i", d, np.linalg.solve(scatter + np.diag(FLOORS[: x.shape[1]] ** 2), d.T).T)


def concentrate(x: np.ndarray, share: float, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """MCD of one block: from several deterministic starts, refit on the nearest `share` of rows until they stay; the least determinant wins."""
    h = max(x.shape[1] + 1, int(np.ceil(share * len(x))))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    order = np.argsort(x[:, 0], kind="stable")
    third = max(1, len(x) // 3)
    starts = [robust_start(x), robust_start(x[order[:-third]]), robust_start(x[order[third:]])] if len(x) > 30 else [robust_start(x)]
    for centre, scatter in starts:
        inside = None
        for _ in range(steps):
            now = np.sort(np.argpartition(distances(x, centre, scatter), min(h, len(x)) - 1)[:h])
            if inside is not None and np.array_equal(now, inside):
                break
            inside = now
            centre, scatter = x[inside].mean(axis=0), np.cov(x[inside].T, bias=True)
        det = np.linalg.slogdet(scatter + np.diag(FLOORS**2))[1]
        if best is None or det < best[0]:
            best = det, centre, scatter
    return best[1], best[2]


def group_names(groups: tuple[str, ...]) -> list[Column]:
    """A row's group, and what small ones share."""
    return [F.to_json(F.struct(*(F.col(quoted(c)).alias(f"g{i}") for i, c in enumerate(some)))) for some in (groups, groups[:1])]


def fails_base(n_words, n_repeat_words, min_words: int, max_repeat_percent: int):
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def of_lists(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists of one length; a null is a row of not a number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.full((len(column), width), np.nan)
    out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def outlying(x: np.ndarray, centre: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Squared distances of vectors, each from its own estimate; not a number without one."""
    out, there = np.full(len(x), np.nan), ~np.isnan(centre[:, 0])
    d = (x - centre)[there]
    wide = scatter[there].reshape(-1, x.shape[1], x.shape[1]) + np.diag(FLOORS**2)
    out[there] = np.einsum("ij,ij->i", d, np.linalg.solve(wide, d[:, :, None])[:, :, 0]) if len(d) else 0.0
    return out


class Rules:
    """The base rules and the estimates (big, centre, scatter: one row for each group met) of a table.

    `rows`, the measured table, is checkpointed. Estimates are broadcast up to `broadcast_groups` groups,
    which are counted; beyond it they are joined by key.
    """

    def __init__(
        self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"),
        min_words: int = 50, max_repeat_percent: int = 50, share: float = 0.75, cutoff: float = 25.0,
        block_rows: int = 1000, min_rows: int = 60, broadcast_groups: int = 20_000,
    ):
        self.docs, self.text_col, self.groups, self.base, self.cutoff = docs, text_col, groups, (min_words, max_repeat_percent), cutoff
        self.rows, self.estimates, many = estimate(docs, id_col, text_col, groups, self.base, share, block_rows, min_rows, broadcast_groups)
        self.by_group = F.broadcast(self.estimates) if many <= broadcast_groups else self.estimates

    def judged(self) -> DataFrame:
        """(id, the five counts, base_failed, kept, distance) of each row."""

        d = len(FEATURES)

        @F.arrow_udf("double")
        def distance(v: pa.Array, centre: pa.Array, scatter: pa.Array) -> pa.Array:
            return pa.array(outlying(of_lists(v, d), of_lists(centre, d), of_lists(scatter, d * d)))

        judged = self.rows.join(self.by_group, "big", "left").withColumn("distance", distance("v", "centre", "scatter"))
        kept = ~F.col("base_failed") & ~F.coalesce((F.col("distance") > self.cutoff) & ~F.isnan("distance"), F.lit(False))
        return judged.select("id", *COUNTS, "base_failed", kept.alias("kept"), F.when(~F.isnan("distance"), F.col("distance")).alias("distance"))

    def kept(self) -> DataFrame:
        """The table's rows that stay, in its columns. Each row is judged by its own text, measured again, so nothing is joined back and no text is shuffled."""
        base, cutoff, d = self.base, self.cutoff, len(FEATURES)

        @F.arrow_udf("boolean")
        def stays(text: pa.Array, centre: pa.Array, scatter: pa.Array) -> pa.Array:
            out = [np.zeros(0, bool)]
            for part in slices([pa.RecordBatch.from_arrays([text, centre, scatter], names=["text", "centre", "scatter"])], "text"):
                s = text_stats(part.column("text"))
                near = ~(outlying(vectors(s), of_lists(part.column("centre"), d), of_lists(part.column("scatter"), d * d)) > cutoff)
                out.append(near & ~fails_base(s["n_words"], s["n_repeat_words"], *base))
            return pa.array(np.concatenate(out))

        names = [free_name(self.docs, c) for c in ("big", "centre", "scatter")]
        keyed = self.docs.withColumn(names[0], group_names(self.groups)[0])
        found = keyed.join(self.by_group.toDF(*names), names[0], "left")
        return found.where(stays(F.col(quoted(self.text_col)), names[1], names[2])).select(*map(quoted, self.docs.columns))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of each document; options as of `Rules`.

    `groups`: columns whose values make a group; the first alone names the fallback of small ones, of under
    `min_rows` rows that pass the base rules, and all rows together that of a fallback still as small.
    `share` of each block is what MCD fits. `cutoff` is the largest squared distance kept: about the 0.9997
    quantile of a normal law of six statistics, over scatter that the floors have widened, as clean text is
    not normal. Blocks hold about `block_rows` rows, whatever the group's size.
    """
    return Rules(docs, **options).judged().withColumnRenamed("id", options.get("id_col", "doc_id"))


def estimate(
    docs: DataFrame, id_col: str, text_col: str, groups: tuple[str, ...], base: tuple[int, int], share: float, block_rows: int, min_rows: int, broadcast_groups: int,
) -> tuple[DataFrame, DataFrame, int]:
    """The measured rows, the estimate of each group met, and the number of groups."""
    d = len(FEATURES)
    kind = dict(docs.dtypes)[id_col]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = text_stats(batch.column("text"))
            v = vectors(s)
            columns = [batch.column("id"), batch.column("big"), batch.column("small")] + [pa.array(s[c], pa.int64()) for c in COUNTS]
            columns.append(pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), d).cast(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "big", "small", *COUNTS, "v"])

    big, small = group_names(groups)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), big.alias("big"), small.alias("small"))
    rows = rows.mapInArrow(measure, f"id {kind}, big string, small string, {', '.join(f'{c} bigint' for c in COUNTS)}, v array<double>")
    rows = cut(rows.withColumn("base_failed", fails_base(F.col("n_words"), F.col("n_repeat_words"), *base)))

    def keyed(left: DataFrame, right: DataFrame, key: str, many: int) -> DataFrame:
        return left.join(F.broadcast(right) if many <= broadcast_groups else right, key)

    good = rows.where(~F.col("base_failed"))
    # every group met has an estimate: its own, its fallback's, or that of all rows
    sizes = rows.groupBy("big", "small").agg(F.count_if(~F.col("base_failed")).alias("n"))
    sizes = cut(sizes.withColumn("grp", F.when(F.col("n") >= min_rows, F.concat(F.lit("own "), "big")).otherwise(F.concat(F.lit("small "), "small"))))
    many = sizes.count()
    few = sizes.groupBy("grp").agg(F.sum("n").alias("m")).where(F.col("m") < min_rows).select("grp", F.lit(True).alias("few"))
    sizes = cut(sizes.join(few, "grp", "left").withColumn("grp", F.when(F.col("few"), F.lit("all")).otherwise(F.col("grp"))).select("big", "n", "grp"))
    # the estimate of all rows is of all rows, not only of those that fall back to it
    every = sizes.agg(F.sum("n").alias("total")).withColumn("grp", F.lit("all"))
    pooling = bool(sizes.where("grp = 'all'").take(1))
    totals = sizes.where("grp <> 'all'").groupBy("grp").agg(F.sum("n").alias("total"))
    totals = totals.unionByName(every) if pooling else totals
    totals = cut(totals.select("grp", F.greatest(F.lit(1), F.ceil(F.col("total") / block_rows)).alias("blocks")))
    named = sizes.select("big", "grp")
    if pooling:
        named = named.where("grp <> 'all'").unionByName(named.select("big", F.lit("all").alias("grp")))
    sizes, dealt = sizes.select("big", "grp"), cut(named.join(totals, "grp"))
    good = keyed(good.select("id", "big", "v"), dealt, "big", many)
    good = good.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["v"].to_numpy())
        if len(x) < 2 * d:
            return pd.DataFrame({"grp": [], "n": [], "centre": [], "scatter": []}, dtype=object)
        centre, scatter = concentrate(x, share)
        return pd.DataFrame({"grp": frame["grp"].iloc[:1].to_list(), "n": [len(x)], "centre": [centre], "scatter": [scatter.ravel()]})

    shape = "grp string, n bigint, centre array<double>, scatter array<double>"
    blocks = good.select("grp", "block", "v").groupBy("grp", "block").applyInPandas(fit, shape)

    def pooled(df: DataFrame, centre: str, scatter: str) -> DataFrame:
        """Weighted means of the blocks' estimates, by element."""
        mean = lambda c, size: F.array(*(F.sum(F.col(c)[i] * F.col("n")) / F.sum("n") for i in range(size)))
        return df.groupBy("grp").agg(mean(centre, d).alias("centre"), mean(scatter, d * d).alias("scatter"))

    first = cut(pooled(blocks, "centre", "scatter"))
    near = 14.4494  # 0.975 quantile of chi-square with six degrees of freedom

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for grp, part in frame.groupby("grp", sort=False):
                x = np.stack(part["v"].to_numpy())
                centre, scatter = part["centre"].iloc[0], np.reshape(part["scatter"].iloc[0], (d, d))
                x = x[distances(x, centre, scatter / share) <= near]
                if len(x):
                    yield pd.DataFrame({"grp": [grp], "n": [len(x)], "centre": [x.mean(axis=0)], "scatter": [(x.T @ x / len(x)).ravel()]})

    second = pooled(keyed(good.select("grp", "v"), first, "grp", many).mapInPandas(moments, shape), "centre", "scatter")
    # second moments about zero; less the centre's, they are the covariance
    less = F.transform("scatter", lambda x, i: x - F.get("centre", F.floor(i / d).cast("int")) * F.get("centre", F.pmod(i, F.lit(d)).cast("int")))
    final = cut(second.select("grp", "centre", less.alias("scatter")))

    return rows, cut(sizes.join(final, "grp", "left").select("big", "centre", "scatter")), many
