"""Quality classifier by co-training.

Two classifiers see a document separately: one its words, one its metadata: language, source, length and
layout (lines, shares of capitals, marks and symbols), no word. Both start from the labelled
sample. In every round each labels all other documents, the pool, and those it is most sure of teach
the other. At the end each view is calibrated on labelled rows it did not learn from, and the calibrated
log-odds are combined, with weights fitted there too, to score every document.

The labelled sample is bounded and hash-chosen. The pool is every document besides it, in its features as
checkpointed once: what a round has taught is not stored but found anew from its models and cuts, and
models are refitted from sums over tasks. Scores are given to all documents. Null
and empty texts have zero statistics, very long ones are measured whole; null metadata are values of
their own. Rows with a null id or label teach nothing; an id labelled both ways counts as 0. Rows equally
sure stand in one bin of log-odds, of which a share by the id's hash is passed on. Repeated rows each
return a row, and teach once. Only id, text and metadata are read, so other names cannot clash. If the
sample lacks either label, scores are 0.5; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .linear import apply, logistic, sigmoid
from .quality_rules import text_stats, vectors
from .words import Words, slices

_BAG = 256
_META = 128
_BINS = 64 * 36  # of log-odds, which sigmoid cuts at 35
_RIDGE = 0.3


def text_view(texts: pa.Array) -> np.ndarray:
    """For each text: shares of hashed words, and how often its words and lines repeat."""
    s = text_stats(texts)
    repeats = np.column_stack([s["n_repeat_words"] / np.maximum(s["n_words"], 1), s["n_dup_lines"] / np.maximum(s["n_lines"], 1)])
    w = Words(texts, lower=True)
    bag = np.zeros((len(texts), _BAG))
    if len(w.starts):
        at = w.doc * _BAG + (w.hashes() % np.uint64(_BAG)).astype(np.int64)
        bag = np.bincount(at, minlength=len(texts) * _BAG).reshape(len(texts), _BAG).astype(float)
    bag = np.sqrt(bag / np.maximum(w.count, 1)[:, None])
    return np.column_stack([repeats, repeats**2, bag])


def layout(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """What a page's header would tell without its words: length, lines, words to a line, letters to a word, and shares of capitals, marks and symbols."""
    s = text_stats(texts)
    v = vectors(s)
    length = np.array([len(t or "") for t in texts.to_pylist()], np.int64)
    words, lines = s["n_words"], np.maximum(s["n_lines"], 1)
    return length, s["n_lines"], words // lines, (16 * v[:, 0]).astype(int), (40 * v[:, 4]).astype(int), (40 * v[:, 5]).astype(int), (40 * v[:, 1]).astype(int)


def meta_view(columns: list[list], shape: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each row: hashed values of the metadata columns and of their pairs, and its layout in steps: the first three in powers of two, the others in even ones."""
    length = shape[0]
    out = np.zeros((len(length), _META + 24 * len(shape)))
    for i, values in enumerate(zip(*columns, strict=True)):
        named = [f"{k}={v}" for k, v in enumerate(values)]
        for key in [*named, *(a + "&" + b for k, a in enumerate(named) for b in named[k + 1 :])]:
            out[i, zlib.crc32(key.encode()) % _META] = 1
    for k, x in enumerate(shape):
        step = np.log2(np.maximum(x, 0) + 1).astype(int) if k < 3 else x
        out[np.arange(len(length)), _META + 24 * k + np.clip(step, 0, 23)] = 1
    return out


#: One round: both views' models, and for view 0's label 0 and 1 and view 1's, the last bin passed on and the share of it.
Round = tuple[list[np.ndarray], list[tuple[int, float]]]
Over = Callable[[Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]], list[np.ndarray]]


def sureness(models: list[np.ndarray], views: list[np.ndarray], sure: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(view taught, label, whether the other view is sure, bin of its log-odds), four times."""
    for k, x in enumerate(views):
        odds = apply(models[k], x)
        for label, o in ((0, -odds), (1, odds)):
            yield 1 - k, label, sigmoid(o) >= sure, np.clip(o * 64, 0, _BINS - 1).astype(int)


def taught(views: list[np.ndarray], point: np.ndarray, told: list[Round], sure: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each view's targets and weights after the rounds `told`. `point`, in [0, 1), decides rows of the last bin."""
    target, weight = ([np.zeros(len(point)) for _ in views] for _ in range(2))
    for models, cuts in told:
        new = [(k, label, ok & (weight[k] == 0) & ((b > at) | ((b == at) & (point < part)))) for (k, label, ok, b), (at, part) in zip(sureness(models, views, sure), cuts, strict=True)]
        for k, label, rows in new:
            target[k][rows], weight[k][rows] = label, 0.5
    return target, weight


def tally(views: list[np.ndarray], point: np.ndarray, told: list[Round], models: list[np.ndarray], sure: float) -> np.ndarray:
    """For each view and label, how many rows that may be passed on have each bin."""
    weight = taught(views, point, told, sure)[1]
    return np.stack([np.bincount(b[ok & (weight[k] == 0)], minlength=_BINS) for k, _, ok, b in sureness(models, views, sure)]).astype(float)


def cut_at(counts: np.ndarray, most: int) -> tuple[int, float]:
    """The last bin, from the surest down, to pass on `most` rows, and the share of it."""
    reach = np.cumsum(counts[::-1])
    if reach[-1] <= most:
        return -1, 0.0
    i = int(np.searchsorted(reach, most, side="right"))
    last = counts[::-1][i]
    return len(counts) - 1 - i, float((most - (reach[i] - last)) / last)


def newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Gradient, upper half of the Hessian and weight of the logistic loss at `w`."""
    x, y, weight = (a[weight > 0] for a in (x, y, weight))
    x = np.column_stack([x, np.ones(len(x))])
    p = sigmoid(x @ w)
    hess = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x
    return [x.T @ (weight * (p - y)), hess[np.triu_indices(len(w))], np.array([weight.sum()])]


def refit(models: list[np.ndarray], known: list[np.ndarray], label: np.ndarray, over: Over, told: list[Round], sure: float, steps: int = 30) -> list[np.ndarray]:
    """Both views' models as `logistic` fits them on the labelled rows and what the rounds have taught, by Newton steps from `models` on."""
    models = list(models)
    going = [0, 1]
    for _ in range(steps):

        def sums(views: list[np.ndarray], point: np.ndarray, at=tuple(models), going=tuple(going)) -> list[np.ndarray]:
            target, weight = taught(views, point, told, sure)
            return [a for k in going for a in newton_sums(views[k], target[k], weight[k], at[k])]

        there = over(sums)
        for i, k in enumerate(list(going)):
            w = models[k]
            grad, half, total = (a + b for a, b in zip(there[3 * i : 3 * i + 3], newton_sums(known[k], label, np.ones(len(label)), w), strict=True))
            hess = np.zeros((len(w), len(w)))
            hess[np.triu_indices(len(w))] = half
            hess = hess + np.triu(hess, 1).T
            penalty = np.full(len(w), _RIDGE * max(1.0, float(total[0])) / 100)
            penalty[-1] = 1e-6
            step = np.linalg.solve(hess + np.diag(penalty), grad + penalty * w)
            models[k] = w - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                going.remove(k)
        if not going:
            break
    return models


class CoTraining:
    """Both views' models, their calibration and its combination."""

    def __init__(self) -> None:
        self.views: list[np.ndarray] = []
        self.calibration: np.ndarray | None = None
        self.exchanged: list[tuple[int, int]] = []

    def fit(self, views: list[np.ndarray], y: np.ndarray, held: np.ndarray, rounds: int, share: float, sure: float, over: Over | None = None) -> CoTraining:
        """`y`: 0, 1, or -1 for the pool; `held` labelled rows are kept for calibration. In each round a view passes on about `share` of the pool at most, if it is `sure`.

        `over` sums a function's arrays over a pool that is elsewhere.
        """
        learn = (y >= 0) & ~held
        if over is None:
            own, point = [x[y < 0] for x in views], np.random.default_rng(0).random(int((y < 0).sum()))
            over = lambda f: f(own, point)
        known, label = [x[learn] for x in views], y[learn].astype(float)
        self.views = [logistic(x, label, ridge=_RIDGE) for x in known]
        told: list[Round] = []
        size = int(over(lambda v, u: [np.array([len(u)], float)])[0][0])
        for _ in range(rounds if size else 0):
            models, before = list(self.views), list(told)
            counts = over(lambda v, u, models=models, before=before: [tally(v, u, before, models, sure)])[0]
            most = max(1, int(share * size))
            told.append((models, [cut_at(c, most) for c in counts]))
            passed = [int(min(c.sum(), most)) for c in counts]
            self.exchanged.append((passed[0] + passed[1], passed[2] + passed[3]))
            self.views = refit(self.views, known, label, over, list(told), sure)
        check = held & (y >= 0)
        odds = np.column_stack([apply(w, x[check]) for w, x in zip(self.views, views, strict=True)])
        if len(np.unique(y[check])) == 2:
            self.calibration = logistic(odds, y[check].astype(float), ridge=1e-2)
        return self

    def score(self, views: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        odds = [apply(w, x) for w, x in zip(self.views, views, strict=True)]
        both = apply(self.calibration, np.column_stack(odds)) if self.calibration is not None else sum(odds)
        return [sigmoid(o) for o in odds], sigmoid(both)


def classify_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    metadata: tuple[str, ...] = ("lang", "source"), labelled: int = 6000, rounds: int = 4,
    share: float = 0.1, sure: float = 0.95, threshold: float = 0.3,
) -> DataFrame:
    """(id, text_score, meta_score, score, keep) of each document; scores are of label 1, kept from `threshold` on.

    At most `labelled` labelled rows are learnt from, those of smallest hash, and all other documents are the pool.
    """
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession
    ids = labels.where(f"`{id_col}` IS NOT NULL AND `{label_col}` IN (0, 1)").select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    chosen = {r.id: r.label for r in ids.orderBy(F.xxhash64("id"), "id").limit(labelled).collect()}
    drawn = [(i, y, zlib.crc32(str(i).encode()) % 4 == 1) for i, y in chosen.items()]
    named = [f"coalesce(cast(`{c}` AS string), 'null') AS m{k}" for k, c in enumerate(metadata)]
    plain = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text", *named)
    names = [f"m{k}" for k in range(len(metadata))]

    def seen(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [text_view(batch.column("text")), meta_view([batch.column(c).to_pylist() for c in names], layout(batch.column("text")))]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            a, b = seen(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("held"), pa.array(a.tolist(), pa.list_(pa.float32())), pa.array(b.tolist(), pa.list_(pa.float32()))], names=["id", "label", "held", "a", "b"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the pool's features."""
        for batch in slices(batches, "text"):
            a, b = seen(batch)
            blob = [zlib.compress(a.astype(np.float32).tobytes(), 1), np.packbits(b.astype(bool), axis=1).tobytes(), batch.column("point").to_numpy().astype(np.float64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blob], names=["a", "b", "point"])

    width = [x.shape[1] for x in (text_view(pa.array(["a"])), meta_view([["a"]] * len(names), layout(pa.array(["a"]))))]

    def over_blocks(blocks: DataFrame, parts: int = 64) -> Over:
        def over(f: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
            zero = f([np.zeros((0, n)) for n in width], np.zeros(0))

            def written(flat: dict[int, np.ndarray]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(flat), pa.int32()), pa.array([x.tobytes() for x in flat.values()], pa.binary())], names=["part", "sums"])

            def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = None
                for batch in batches:
                    for a, b, point in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "point")), strict=True):
                        u = np.frombuffer(point)
                        x = np.frombuffer(zlib.decompress(a), np.float32).reshape(len(u), width[0]).astype(float)
                        m = np.unpackbits(np.frombuffer(b, np.uint8).reshape(len(u), -1), axis=1)[:, : width[1]].astype(float)
                        flat = np.concatenate([r.ravel() for r in f([x, m], u)])
                        total = flat if total is None else total + flat
                if total is not None:
                    yield written(dict(enumerate(np.array_split(total, parts))))

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                flat: dict[int, np.ndarray] = {}
                for batch in batches:
                    for k, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                        flat[k] = np.frombuffer(raw) + flat.get(k, 0.0)
                if flat:
                    yield written(flat)

            shape = "part int, sums binary"
            got = blocks.mapInArrow(here, shape).repartition(min(parts, partitions(spark)), "part").mapInArrow(add, shape).collect()
            flat = np.concatenate([np.frombuffer(r.sums) for r in sorted(got, key=lambda r: r.part)]) if got else np.concatenate([z.ravel() for z in zero])
            ends = np.cumsum([z.size for z in zero])[:-1]
            return [x.reshape(z.shape) for x, z in zip(np.split(flat, ends), zero, strict=True)]

        return over

    model = CoTraining()
    if len(set(chosen.values())) == 2:
        sample = plain.join(F.broadcast(spark.createDataFrame(drawn, "id bigint, label int, held boolean")), "id")
        # one row an id, the least text by digest where rows repeat it, in the order of ids: at most `labelled` rows, the same on any partitioning
        one = sample.groupBy("id").agg(F.min_by(F.struct(*(c for c in sample.columns if c != "id")), F.struct(F.md5("text"), *names)).alias("r")).select("id", "r.*")
        rows: pd.DataFrame = one.mapInArrow(measured, "id bigint, label int, held boolean, a array<float>, b array<float>").toPandas().sort_values("id")
        y = rows["label"].to_numpy()
        if {0, 1} <= set(y[~rows["held"].to_numpy(bool)]):
            known = spark.createDataFrame([(i,) for i in chosen], "id bigint")
            rest = plain.where("id IS NOT NULL").join(F.broadcast(known), "id", "left_anti")
            point = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 32)) / float(1 << 32)).alias("point")
            blocks = cut(rest.select("text", *names, point).mapInArrow(packed, "a binary, b binary, point binary"))
            model.fit([np.stack(rows[c].to_numpy()).astype(float) for c in "ab"], y, rows["held"].to_numpy(bool), rounds, share, sure, over_blocks(blocks))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text"):
            if model.views:
                (text, meta), both = model.score(seen(batch))
            else:
                text = meta = both = np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.float64()) for x in (text, meta, both)), pa.array(both >= threshold)], names=[id_col, "text_score", "meta_score", "score", "keep"])

    return plain.mapInArrow(run, f"{id_col} {kind}, text_score double, meta_score double, score double, keep boolean")
