"""Toxicity scores of noisy-channel restored text.

Words written in leetspeak, with letters spaced or dotted apart, or stretched by repetition are decoded:
each character of a token opens the letters it may stand for, or none, and a Viterbi search through this
lattice under a character language model finds the likeliest word. The restored words are then scored by
a lexicon of words and word beginnings, and a logistic regression over what a text's words reach. A run
of three or more marks behind a word, and hexadecimal digests, are no disguise and open no lattice.

One pass gathers the trigrams of all documents, held-out ones included, as the language model needs no
labels, and the distinct tokens that ask to be decoded. A token's lattice names the trigrams that it
needs, and these alone are joined to it: neither the driver nor a task holds the model. Decoded words
that the lexicon knows go back to the texts by their tokens. Lexicon and regression are fitted on a
bounded, hash-chosen sample of labelled rows (`per_class` of each label). For the regression each half of
it is measured with the other half's lexicon. Every whole text is scored.

Null and empty texts have no words and get the regression's score for none; very long ones are scored
whole. Rows with a null id or label teach nothing; an id labelled both ways counts as toxic. Repeated
rows each return a row. Decodings of equal cost go by the alphabet. Only id and text are read, so other
names cannot clash. If the sample lacks either label, all scores are 0; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_classes
from .linear import logistic
from .words import slices

#: The letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
_BETWEEN = ".-_*~'·,/"
_EDGE = ".,;:?\"'()[]{}<>«»…“”‘’`"
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+[.,;:!?]*")
_RUN = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){2,}(?!\S)")
_TAIL = re.compile(r"(?:[^\w\s]|_){3,}$")
_DIGEST = re.compile(r"[0-9a-f]{16,}")
_LOW, _HIT = 3.0, 4.5  # weights (log-odds) that rare words reach by chance, and that count as hits
_BITS = 21  # of a character
_LEAST = 3  # texts of label 1 that a lexicon entry needs


def code(chars: str) -> int:
    """Up to three characters as one number."""
    out = 0
    for c in chars:
        out = out << _BITS | ord(c)
    return out


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def word_grams(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the trigrams of words with their counts."""
    chars = np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(w) + 3 for w in words], np.int64)
    inside = np.ones(len(chars), bool)
    ends = np.cumsum(size)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    return summed(chars[at] << 2 * _BITS | chars[at + 1] << _BITS | chars[at + 2], np.repeat(np.array(list(words.values()), np.int64), size)[at])


def gathered(docs: DataFrame, text_col: str, most: int = 300_000) -> DataFrame:
    """(gram, n, core): the trigrams of each document's distinct words, counted, and the strings that tokens ask to be decoded, over all documents.

    A task folds up to about `most` distinct tokens before it passes them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        word: dict[str, str | None] = {}  # of a token that is one
        several: dict[str, list[str]] = {}  # of the others

        def told() -> pa.RecordBatch:
            codes, counts = word_grams({w: n for w, n in seen.items() if not _RUN.search(w)})
            asked = sorted({c for t in word for c in cores(t)})
            columns = [pa.array([*codes.tolist(), *[None] * len(asked)], pa.int64()), pa.array([*counts.tolist(), *[None] * len(asked)], pa.int64()), pa.array([*[None] * len(codes), *asked], pa.string())]
            for held in (seen, word, several):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["gram", "n", "core"])

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                found = tokens(text)
                for t in found.difference(word):
                    parts = restore(t, None)
                    word[t] = parts[0] if len(parts) == 1 else None
                    if len(parts) != 1:
                        several[t] = parts
                words = set(map(word.__getitem__, found))
                if None in words:
                    words.discard(None)
                    for t in found.intersection(several):
                        words.update(several[t])
                seen.update(words)
            if len(word) > most:
                yield told()
        if word:
            yield told()

    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "gram bigint, n bigint, core string")


class Channel:
    """A character trigram model with the lattice search on it. `grams`: counts of character trigrams, words being padded by two spaces and closed by one."""

    def __init__(self, grams: dict[str, int]):
        codes, counts = np.array([code(g) for g in grams], np.int64), np.array(list(grams.values()), np.int64)
        table = lambda c: dict(zip(*(x.tolist() for x in summed(c, counts)), strict=True))
        self._set(table(codes), table(codes >> _BITS), table(codes & ((1 << _BITS) - 1)), int(counts.sum()) + 1)

    def _set(self, three: dict[int, int], two: dict[int, int], one: dict[int, int], total: int) -> None:
        self.three, self.two, self.one, self.total = three, two, one, total
        self.memory: dict[str, float] = {}

    @classmethod
    def of(cls, three: dict[int, int], two: dict[int, int], one: dict[int, int], total: int) -> Channel:
        """The part of a model that some lattice asks for: counts of trigrams, of their first two characters, of their last, and of all and one more."""
        out = cls.__new__(cls)
        out._set(three, two, one, total)
        return out

    def cost(self, before: str, char: str) -> float:
        """Negative log-probability of a character after two others, smoothed by that of the character alone."""
        key = before + char
        if (c := self.memory.get(key)) is None:
            alone = (self.one.get(ord(char), 0) + 0.5) / (self.total + 50)
            c = self.memory[key] = -math.log((self.three.get(code(key), 0) + 2 * alone) / (self.two.get(code(before), 0) + 2))
        return c

    @staticmethod
    def options(token: str) -> list[list[tuple[str, float]]]:
        """For each character, the letters it may be and the channel's price of each; the empty letter is silence."""
        out = []
        for i, c in enumerate(token):
            here = [(c, 0.0)] if c.isalpha() else []
            here += [(x, 0.3) for x in LEET.get(c, "")]
            if c.isalpha() and i and token[i - 1] == c:
                here.append(("", 0.1 if token[max(0, i - 2) : i + 2].count(c) > 2 else 2.5))
            if c in _BETWEEN or not here:
                here.append(("", 0.5))
            out.append(here)
        return out

    def decode(self, token: str) -> str:
        """The likeliest word behind a token."""
        states: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
        for here in self.options(token):
            after: dict[str, tuple[float, str]] = {}
            for last, (spent, word) in states.items():
                for char, price in here:
                    c = spent + price + (self.cost(last, char) if char else 0.0)
                    key = last[1] + char if char else last
                    if key not in after or (c, word + char) < after[key]:
                        after[key] = c, word + char
            states = after
        return min((c + self.cost(last, " "), word) for last, (c, word) in states.items())[1]


def asked(token: str) -> tuple[set[int], set[int]]:
    """The codes of all trigrams that a token's lattice may ask for, and of their first two characters."""
    states, three = {"  "}, set()
    for here in Channel.options(token):
        after = set()
        for last in states:
            for char, _ in here:
                if char:
                    three.add(code(last + char))
                    after.add(last[1] + char)
                else:
                    after.add(last)
        states = after
    three.update(code(last + " ") for last in states)
    return three, {t >> _BITS for t in three}


def disguised(token: str) -> bool:
    """Whether a token is worth decoding: letters among stand-ins or separators, or a letter three times in a row; no digest."""
    if _DIGEST.fullmatch(token):
        return False
    if _RUN.search(token):
        return True
    return any(c.isalpha() for c in token) and any(c in LEET or c in _BETWEEN for c in token)


def cores(token: str) -> list[str]:
    """What of a lower-cased token is to be decoded, if anything: it without marks around it, and with its last ones where they may be letters."""
    if _PLAIN.fullmatch(token) and not _RUN.search(token):
        return []
    core = _TAIL.sub("", token.strip(_EDGE))
    if not disguised(core):
        return []
    bare = core.rstrip("!") or core
    return [bare, core] if core != bare else [bare]


def restore(token: str, channel: Channel | None) -> list[str]:
    """The words that a lower-cased token holds, as it stands and as decoded."""
    if _PLAIN.fullmatch(token) and not _RUN.search(token):
        return [token.rstrip(".,;:!?")]
    out = _LETTERS.findall(token.strip(_EDGE))
    return out + [channel.decode(c) for c in cores(token)] if channel is not None else out


def tokens(text: str | None) -> set[str]:
    """The distinct lower-cased tokens of a text, and its runs of single characters with the spaces between taken out."""
    if not text:
        return set()
    low = text.lower()
    out = set(low.split())
    if min(map(len, out), default=2) == 1:
        for m in _SPACED.finditer(low.replace("\n", " ")):
            out.add("".join(m[0].split(" ")))
    return out


def features(word: str) -> list[str]:
    """A word, and its beginnings of four to six letters."""
    return [word + "$", *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


def restored(docs: DataFrame, text_col: str) -> DataFrame:
    """(core, word): every string that a token of `docs` asks to be decoded, and its decoding under the trigrams of all documents.

    A string gives the codes that its lattice may ask for, which are joined to the counts; its own counts
    are then all that its search holds. Counts of single characters, at most as many as there are
    characters, are broadcast.
    """
    found = cut(gathered(docs, text_col))
    three = cut(found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")))
    two = three.groupBy(F.shiftright("gram", _BITS).alias("code")).agg(F.sum("n").alias("n"))
    last = three.groupBy(F.col("gram").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("char")).agg(F.sum("n").alias("n")).collect()
    one, total = {r.char: r.n for r in last}, sum(r.n for r in last) + 1
    shared = docs.sparkSession.sparkContext.broadcast(one)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 1000):
                rows = [(c, size, v) for c in batch.column("core")[part : part + 1000].to_pylist() for size, codes in zip((3, 2), asked(c), strict=True) for v in codes]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["core", "size", "code"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for core, sizes, codes, n in zip(*(batch.column(c).to_pylist() for c in ("core", "sizes", "codes", "n")), strict=True):
                tables: dict[int, dict[int, int]] = {2: {}, 3: {}}
                for s, c, k in zip(sizes, codes, n, strict=True):
                    tables[s][c] = k
                words.append(Channel.of(tables[3], tables[2], shared.value, total).decode(core))
            yield pa.RecordBatch.from_arrays([batch.column("core"), pa.array(words, pa.string())], names=["core", "word"])

    wanted = found.where("core IS NOT NULL").select("core").distinct().mapInArrow(ask, "core string, size int, code bigint")
    counts = three.select(F.lit(3).alias("size"), F.col("gram").alias("code"), "n").unionByName(two.select(F.lit(2).alias("size"), "code", "n"))
    met = wanted.join(counts, ["size", "code"], "left").select("core", F.struct("size", "code", F.coalesce("n", F.lit(0)).alias("n")).alias("c"))
    own = met.groupBy("core").agg(F.collect_list("c").alias("c")).select("core", *(F.col(f"c.{f}").alias(g) for f, g in (("size", "sizes"), ("code", "codes"), ("n", "n"))))
    return cut(own.mapInArrow(decode, "core string, word string"))


def _key(core: str) -> int:
    return int.from_bytes(hashlib.blake2b(core.encode(), digest_size=8).digest(), "little", signed=True)


def _weight(words: list[str], lexicon: dict[str, float]) -> float:
    return max((lexicon.get(f, 0.0) for w in words for f in features(w)), default=0.0)


def reach(docs: DataFrame, lexicon: dict[str, float], words: DataFrame | None, keep: int = 400_000) -> DataFrame:
    """`docs` less `text`, with x: how far the greatest and second weight of the text's words exceed what chance gives, and how many count.

    A pass over the texts weighs words as they stand and names the strings to be decoded; those whose word
    is in the lexicon come back to their rows by a join. `keep` bounds the tokens remembered per worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [c for c in docs.columns if c != "text"]
    one = pa.struct([("t", pa.int32()), ("w", pa.float64())])
    other = pa.struct([("t", pa.int32()), ("core", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, list[int]] | None] = {}  # None for most: neither a weight nor anything to decode
        for batch in slices(batches, "text"):
            plain, hidden = [], []
            for text in batch.column("text").to_pylist():
                found = tokens(text)
                if len(known) + len(found) > keep:
                    known.clear()
                for token in found.difference(known):
                    k = _weight(restore(token, None), shared.value), [_key(c) for c in cores(token)]
                    known[token] = k if k[0] > 0 or k[1] else None
                met = [(t, k) for t, k in enumerate(map(known.__getitem__, found)) if k is not None]
                here = [{"t": t, "w": w} for t, (w, _) in met if w > 0]
                there = [{"t": t, "core": c} for t, (_, asked) in met for c in asked]
                # words that stand plainly can be folded: the two greatest, and those that count
                folded = [x for x in here if x["w"] > _HIT] or sorted(here, key=lambda x: -x["w"])[:2]
                hid = {x["t"] for x in there}
                plain.append(folded + [x for x in here if x["t"] in hid and x not in folded] if len(folded) > 1 else here)
                hidden.append(there)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(plain, pa.list_(one)), pa.array(hidden, pa.list_(other))], names=[*names, "plain", "hidden"])

    kinds = dict(docs.dtypes)
    rows = docs.mapInArrow(weigh, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", plain array<struct<t:int,w:double>>, hidden array<struct<t:int,core:bigint>>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    if words is not None:

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(_key(c), w) for c, word in zip(batch.column("core").to_pylist(), batch.column("word").to_pylist(), strict=True) if (w := _weight([word], shared.value)) > 0]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([w for _, w in found], pa.float64())], names=["core", "w"])

        each = rows.where(F.size("hidden") > 0).select("row", F.explode("hidden").alias("h")).select("row", "h.t", "h.core")
        hits = cut(words.mapInArrow(judged, "core bigint, w double").groupBy("core").agg(F.max("w").alias("w")))
        counted = each.groupBy("core").agg(F.count("*").alias("n")).join(hits, "core")
        back = join_classes(each, counted, "core", each.count()).groupBy("row").agg(F.collect_list(F.struct("t", "w")).alias("decoded"))  # as many as the text has tokens, at most
        rows = rows.join(back, "row", "left").withColumn("plain", F.concat("plain", F.coalesce("decoded", F.expr("CAST(array() AS array<struct<t:int,w:double>>)"))))
    best = F.map_values(F.aggregate("plain", F.expr("CAST(map() AS map<int,double>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["t"]), F.create_map(p["t"], F.greatest(p["w"], F.coalesce(F.try_element_at(m, p["t"]), F.lit(0.0)))))))
    ranked = F.sort_array(best, False)
    over = lambda i: F.greatest(F.lit(0.0), F.coalesce(F.get(F.col("ranked"), F.lit(i)), F.lit(0.0)) - _LOW)
    x = F.array(over(0), over(1), F.log1p(F.size(F.filter("ranked", lambda w: w > _HIT)).cast("double")))
    return rows.withColumn("ranked", ranked).select(*names, x.alias("x"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, words: DataFrame | None) -> tuple[dict[str, float], np.ndarray | None]:
    """Lexicon and regression, from `per_class` labelled rows of each class at most, those of smallest hash."""
    ids = labels.where(f"`{id_col}` IS NOT NULL AND `{label_col}` IN (0, 1)").select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = [r for y in (0, 1) for r in ids.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    if len({r.label for r in chosen}) < 2:
        return {}, None
    few = docs.sparkSession.createDataFrame([(r.id, r.label, zlib.crc32(str(r.id).encode()) >> 8 & 1) for r in chosen], "id bigint, label int, half int")
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").where("text IS NOT NULL")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for frame in frames:
            for text, label, half in zip(frame["text"], frame["label"], frame["half"], strict=True):
                words = {w for t in tokens(text) for w in restore(t, None)}
                at = 2 * half + label
                for key in {f for w in words for f in features(w)}:
                    seen.setdefault(key, [0] * 4)[at] += 1
        if seen:
            yield pd.DataFrame({"key": list(seen), **{f"n{i}": [n[i] for n in seen.values()] for i in range(4)}})

    texts = cut(sample.groupBy(F.md5("text")).agg(F.first("text").alias("text"), F.max("label").alias("label"), F.min("half").alias("half")).select("text", "label", "half"))
    counts = texts.mapInPandas(counted, "key string, n0 bigint, n1 bigint, n2 bigint, n3 bigint").groupBy("key").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))
    counts = cut(counts.where(f"n1 + n3 >= {_LEAST}"))
    sizes = Counter({(r.half, r.label): r["n"] for r in texts.groupBy("half", "label").agg(F.count("*").alias("n")).collect()})

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        clean, bad = ("+".join(f"n{2 * h + y}" for h in halves) for y in (0, 1))
        all_clean, all_bad = (sum(sizes[h, y] for h in halves) for y in (0, 1))
        odds = F.log((F.expr(bad) + 0.5) / (all_bad + 1.0)) - F.log((F.expr(clean) + 0.5) / (all_clean + 1.0))
        rows = counts.where(f"{bad} >= {_LEAST}").withColumn("odds", odds).where("odds > 1").collect()
        return {r.key: r.odds for r in rows}

    halves = [reach(texts.where(F.col("half") == h).select("label", "text"), lexicon((1 - h,)), words) for h in (0, 1)]
    rows = halves[0].unionByName(halves[1]).collect()  # of the sample
    regression = None
    if len({r.label for r in rows}) == 2:
        x = np.vstack([np.array([r.x for r in rows]), np.zeros((20, 3))])  # texts without words are clean
        regression = logistic(x, np.array([float(r.label) for r in rows] + [0.0] * 20), ridge=1e-3)
    return lexicon((0, 1)), regression


def held_out(id_: Column) -> Column:
    return F.crc32(F.col(id_).cast("string").cast("binary")) % 4 == 2


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.3, per_class: int = 3000, channel: bool = True,
) -> DataFrame:
    """(id, held_out, score, predicted) of each document. Labels of held-out rows, by a hash of the id, are never learnt from.

    `per_class` bounds the labelled sample, and with it the lexicon of its words, which is broadcast.
    Without `channel` nothing is decoded, to measure what decoding adds.
    """
    words = restored(docs, text_col) if channel else None
    lexicon, regression = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col, per_class, words)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    if regression is None:
        scored = rows.select("id", "held_out", F.lit(0.0).alias("score"))
    else:
        odds = sum((F.get("x", F.lit(i)) * float(w) for i, w in enumerate(regression[:-1])), F.lit(float(regression[-1])))
        scored = reach(rows, lexicon, words).select("id", "held_out", (1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), odds))))).alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
