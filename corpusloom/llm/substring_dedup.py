"""Substring dedup by repeated-phrase automata.

A passage of `window` consecutive words is removed from a document if a document of smaller id holds
it too. The steps:

1. Anchors. Each window holds a least-hash phrase of `anchor` words. Equal windows have equal anchors,
   so a window whose anchor is met in one document only does not recur. Anchors are counted in a table
   whose number of cells follows the input's bytes; cells met twice make a bitmap that is broadcast. A
   shared cell lets a window pass needlessly, and loses none.
2. Confirmation. Hashes of the passing windows are shuffled; those of two or more documents are the
   confirmed recurring passages, and the smallest id of each is its owner. Windows of very common
   anchors are folded by salted keys first, so no task gets all rows of a hot passage.
3. Passages. Owners, found by id, give the words of their confirmed passages to each shard of documents
   that holds a later copy of any.
4. Automata. Each shard compiles Aho-Corasick automata over word symbols from the distinct passages sent
   to it, once, and streams all its documents through them. A passage is in an automaton by its phrases
   of half a window at every half window, one of which lies in any window; an occurrence is extended to
   the words around it, compared byte by byte, and removed where it reaches a window of a smaller owner.

Confirmation compares 64-bit hashes, location compares words. Null and empty texts have no words and
lose none; very long texts are handled whole, their passages in overlapping pieces. Rows that repeat an
id are one document to each other: neither removes the other's words. Rows without an id neither lose
nor remove words. Of equal passages the smallest id's stays whole, so there are no ties. Other columns
are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, cut, partitions
from .sketch import member_test
from .words import Words, mix, sliding_min, slices, sorted_unique

_SLICES = 64


def window_anchors(w: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window and the positions where windows begin."""
    phrase, _ = w.windows(hashes, anchor)
    least = sliding_min(phrase, window - anchor + 1)
    where = np.flatnonzero(w.windows_inside(window))
    return least, where


def _cells(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def recurring_cells(docs: DataFrame, window: int, anchor: int, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of the cells that hold anchors of two or more documents, 2**bits bits, packed; and the cells met by more than `hot`."""
    size = 1 << bits
    part = size // _SLICES

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, held = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            cells = np.sort(np.concatenate(once))
            cuts = np.searchsorted(cells, np.arange(_SLICES + 1) * part)
            packed = []
            for k in range(_SLICES):
                own = cells[cuts[k] : cuts[k + 1]]
                packed.append(zlib.compress(np.diff(own, prepend=k * part).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "cells"])

        for batch in slices(batches, "text"):
            w = Words(batch.column("text"))
            least, where = window_anchors(w, w.hashes(), window, anchor)
            doc, value = w.doc[where], least[where]
            if not len(where):
                continue
            new = np.ones(len(where), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            _, value = sorted_unique(doc[new], value[new])
            once.append(_cells(value, bits))
            held += len(value)
            if held > 4_000_000:
                yield from told()
                once, held = [], 0
        if once:
            yield from told()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T
                cells = np.cumsum(np.ascontiguousarray(raw).view(np.uint32).ravel(), dtype=np.int64)
                counts = seen.setdefault(k, np.zeros(part, np.uint32))
                at, n = np.unique(cells, return_counts=True)
                counts[at] += n.astype(np.uint32)
        if seen:
            often = [(np.flatnonzero(x > hot) + k * part).astype(np.int64).tobytes() for k, x in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([zlib.compress(np.packbits(x > 1).tobytes(), 1) for x in seen.values()], pa.binary()), pa.array(often, pa.binary())], names=["slice", "cells", "often"])

    told = docs.select("text").mapInArrow(tally, "slice int, cells binary").repartition(min(_SLICES, partitions(docs.sparkSession)), "slice").mapInArrow(merge, "slice int, cells binary, often binary")
    out, often = np.zeros(size // 8, np.uint8), [np.zeros(0, np.int64)]
    step = part // 8
    for k, packed, most in told.toLocalIterator():
        out[k * step : (k + 1) * step] = np.frombuffer(zlib.decompress(packed), np.uint8)
        often.append(np.frombuffer(most, np.int64))
    return out, np.sort(np.concatenate(often))


def _seven(values: np.ndarray) -> bytes:
    """The low seven bytes of each value; the top one names the bucket."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(raw: bytes, top: int) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    out = np.empty((len(low), 8), np.uint8)
    out[:, :7], out[:, 7] = low, top
    return out.view(np.uint64).ravel()


def _planes(values: np.ndarray) -> bytes:
    """64-bit values by byte places, which compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(parts: list[bytes], kind: type) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel() for x in parts]) if parts else np.zeros(0, kind)


_PRIME, _FACTOR = 2147483647, 1103515245


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """The shard of integer ids: a product modulo a prime first, so ids in steps do not crowd."""
    return ids % _PRIME * _FACTOR % _PRIME % shards


def ends_of(value: np.ndarray, dest: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (value, shard, id), the least and the greatest id of each (value, shard) only: all that confirmation needs."""
    order = np.lexsort((ids, dest, value))
    value, dest, ids = value[order], dest[order], ids[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (dest[1:] != dest[:-1])
    keep = new.copy()
    keep[:-1] |= new[1:]
    keep[-1:] = True
    return value[keep], dest[keep], ids[keep]


def joined(w: Words, which: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The words (those numbered `which`), each with a space behind it, and where each begins, with the end as last."""
    a, n = (w.starts, w.ends - w.starts) if which is None else (w.starts[which], w.ends[which] - w.starts[which])
    at = np.concatenate([[0], np.cumsum(n + 1)])
    take = np.arange(at[-1]) + np.repeat(a - at[:-1], n + 1)
    if len(take):
        take = np.minimum(take, len(w.data) - 1)
    out = w.data[take] if len(take) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = 0x20
    return out.tobytes(), at


def symbols(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[str, str]:
    """Words as code points, one for each word of a sorted vocabulary of hashes and U+0000 for any other; and as three digits each.

    The digits are what automata read: a node's branches are searched one by one, so there must be few.
    Each place has digits of its own, so nothing matches across the places.
    """
    at = np.searchsorted(vocabulary, hashes)
    known = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes)
    code = np.where(known, at + 1, 0)
    base = int(np.ceil((len(vocabulary) + 1) ** (1 / 3))) + 1
    digits = np.stack([code // base**2, code // base % base + base, code % base + 2 * base], axis=1) + 1
    digits[~known] = 0
    text = lambda x: x.astype("<u4").tobytes().decode("utf-32-le")
    return text(code + 0x800 * (code >= 0xD800)), text(digits)


def pieces(passages: list[tuple[int, bytes]], most: int = 1_000_000) -> Iterator[list[tuple[int, bytes]]]:
    """Passages in parts of about `most` words, which bounds an automaton and its symbols (under 1.1 million)."""
    part, held = [], 0
    for p in passages:
        n = p[1].count(b" ") + 1
        if part and held + n > most:
            yield part
            part, held = [], 0
        part.append(p)
        held += n
    if part:
        yield part


class Phrases:
    """An automaton of passages (owner, words joined by single spaces), and the occurrences that it finds."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int):
        self.window, self.seed = window, (window + 1) // 2
        w = Words(pa.array([p for _, p in passages], pa.binary()).cast(pa.string()))
        hashes = w.hashes()
        self.vocabulary = np.unique(hashes)
        self.spelled, digits = symbols(hashes, self.vocabulary)
        self.bytes, self.at = joined(w)
        self.cuts = w.first_word.tolist()
        step, seeds = window - self.seed + 1, {}
        for k, (owner, _) in enumerate(passages):
            a, b = self.cuts[k], self.cuts[k + 1]
            for i in range(a, b - self.seed + 1, step):
                seeds.setdefault(digits[3 * i : 3 * (i + self.seed)], []).append((i, a, b, owner))
        self.automaton = ahocorasick.Automaton()
        for phrase, places in seeds.items():
            self.automaton.add_word(phrase, places)
        self.automaton.make_automaton()

    def occurrences(self, spelled: str, digits: str, a: int, b: int, mine: int, gone: bytearray, text: bytes, at: np.ndarray) -> None:
        """Marks in `gone` the words a to b of a document that windows of smaller owners cover."""
        own, seed, room = self.spelled, self.seed, self.window - self.seed
        for end, places in self.automaton.iter(digits, 3 * a, 3 * b):
            e = end // 3 + 1
            s = e - seed
            left, right = min(room, s - a), min(room, b - e)
            if left + seed + right < self.window or gone.find(0, s - left, e + right) < 0:
                continue
            for i, first, last, owner in places:
                if owner >= mine:
                    continue
                l, r = min(left, i - first), min(right, last - i - seed)
                if own[i - l : i] != spelled[s - l : s]:
                    l = next(k for k in range(l) if own[i - 1 - k] != spelled[s - 1 - k])
                j = i + seed
                if own[j : j + r] != spelled[e : e + r]:
                    r = next(k for k in range(r) if own[j + k] != spelled[e + k])
                if l + seed + r < self.window or text[at[s - l] : at[e + r]] != self.bytes[self.at[i - l] : self.at[j + r]]:
                    continue
                gone[s - l : e + r] = b"\x01" * (l + seed + r)
                if l == left and r == right:
                    break


def dedup_shard(texts: pa.Array, ids: list[int | None], found: list[Phrases]) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed, kept words joined by spaces) of each text, streamed through a shard's automata."""
    w = Words(texts)
    hashes = w.hashes()
    text, at = joined(w)
    gone = bytearray(len(w.starts))
    cuts = w.first_word.tolist()
    for phrases in found:
        spelled, digits = symbols(hashes, phrases.vocabulary)
        for i, mine in enumerate(ids):
            if mine is not None and cuts[i + 1] - cuts[i] >= phrases.window:
                phrases.occurrences(spelled, digits, cuts[i], cuts[i + 1], mine, gone, text, at)
    kept = np.flatnonzero(np.frombuffer(gone, np.uint8) == 0)
    left, there = (text, at) if len(kept) == len(gone) else joined(w, kept)
    ends = np.searchsorted(kept, cuts)
    for i in range(len(ids)):
        n, m = cuts[i + 1] - cuts[i], int(ends[i + 1] - ends[i])
        yield n, n - m, left[there[ends[i]] : there[ends[i + 1]] - 1] if m else b""


def passages_of(texts: pa.Array, ids: list[int], value: np.ndarray, owner: np.ndarray, dest: np.ndarray, window: int, longest: int = 200_000) -> Iterator[tuple[int, int, bytes]]:
    """(shard, owner, passage) of runs of confirmed windows; `owner` is sorted. A run of over `longest` words comes in pieces that overlap by a window less a word."""
    w = Words(texts)
    text, at = joined(w)
    hashes, where = w.windows(w.hashes(), window)
    doc = w.doc[where]
    lo, hi = np.searchsorted(doc, np.arange(len(ids))), np.searchsorted(doc, np.arange(len(ids)), "right")
    for i, mine in enumerate(ids):
        a, b = np.searchsorted(owner, mine), np.searchsorted(owner, mine, "right")
        if a == b:
            continue
        order = np.argsort(value[a:b], kind="stable")
        wanted, to = value[a:b][order], dest[a:b][order]
        here = where[lo[i] : hi[i]]
        first, last = np.searchsorted(wanted, hashes[here]), np.searchsorted(wanted, hashes[here], "right")
        n = last - first
        position = np.repeat(here, n)
        shard = to[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((position, shard))
        position, shard = position[order], shard[order]
        new = np.ones(len(position), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (position[1:] != position[:-1] + 1)
        begins = np.flatnonzero(new)
        for s, e in zip(begins.tolist(), np.append(begins[1:], len(position)).tolist() if len(begins) else [], strict=False):
            x, y = int(position[s]), int(position[e - 1]) + window
            for k in range(x, max(x + 1, y - window + 1), longest):
                yield int(shard[s]), mine, text[at[k] : at[min(y, k + longest + window - 1)] - 1]


def substring_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, anchor: int = 5, bits: int | None = None,
    shards_per_partition: int = 4, shard_bytes: int = 24 << 20, hot: int = 1_000_000, with_text: bool = False,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of each document; ids are integers.

    The bitmap of anchors has about a bit for every eight bytes of text, 2**30 (128 MB) at most; past that
    more windows are shuffled than recur, with the same result. Buckets are at least as many as the
    session's shuffle partitions; shards are four times as many, and more where one would hold over
    `shard_bytes` of text. Windows of anchors that over `hot` documents share are folded by salts.
    """
    spark = docs.sparkSession
    everything = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    texts = everything.where(F.col("id").isNotNull())
    rows, volume = everything.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = bits or min(30, max(16, (volume // 8).bit_length()))
    table, often = (spark.sparkContext.broadcast(x) for x in recurring_cells(texts, window, anchor, bits, hot))
    deal, shards = bucket_bits(spark), max(shards_per_partition * partitions(spark), -(-volume // shard_bytes))
    kind = dict(docs.dtypes)[id_col]

    def passing(crowded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bitmap, most = table.value, often.value
            for turn, batch in enumerate(slices(batches, "text", 8 << 20)):
                w = Words(batch.column("text"))
                hashes = w.hashes()
                least, where = window_anchors(w, hashes, window, anchor)
                if not len(where):
                    continue
                cell = _cells(least[where], bits)
                keep = (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
                if len(most):
                    at = np.minimum(np.searchsorted(most, cell), len(most) - 1)
                    keep &= (most[at] == cell) == crowded
                where = where[keep]
                if not len(where):
                    continue
                values, _ = w.windows(hashes, window)
                ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)[w.doc[where]]
                value, _, ids = ends_of(values[where], shard_of(ids, shards), ids)
                cuts = np.searchsorted(value >> np.uint64(64 - deal), np.arange((1 << deal) + 1).astype(np.uint64))
                cut_rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                columns = [pa.array([k for k, _, _ in cut_rows], pa.int32()), pa.array([(turn + int(ids[0])) % 64] * len(cut_rows), pa.int32())]
                columns += [pa.array([_seven(value[a:b]) for _, a, b in cut_rows], pa.binary()), pa.array([_planes(ids[a:b]) for _, a, b in cut_rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "salt", "value", "ids"])

        return run

    def unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = int(frame["bucket"].iloc[0]) >> (deal - 8)
        value, ids = np.concatenate([_eight(x, top) for x in frame["value"]]), _values(list(frame["ids"]), np.int64)
        return ends_of(value, shard_of(ids, shards), ids)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        value, _, ids = unpacked(frame)
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1].to_list(), "value": [_seven(value)], "ids": [_planes(ids)]})

    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        value, dest, ids = unpacked(frame)
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        owner = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(value))))
        last = np.ones(len(value), bool)  # of its value and shard: the greatest id
        last[:-1] = (value[1:] != value[:-1]) | (dest[1:] != dest[:-1])
        hit = last & (ids > owner)
        value, dest, owner = value[hit], dest[hit], owner[hit]
        home = shard_of(owner, shards)
        order = np.argsort(home, kind="stable")
        value, dest, owner, home = value[order], dest[order], owner[order], home[order]
        at, start = np.unique(home, return_index=True)
        ends = np.append(start[1:], len(home))[: len(at)]
        part = lambda x, f: [f(x[a:b]) for a, b in zip(start, ends, strict=True)]
        return pd.DataFrame({"shard": at, "value": part(value, _planes), "owner": part(owner, _planes), "dest": part(dest.astype(np.int32), np.ndarray.tobytes)})

    packed = "bucket int, salt int, value binary, ids binary"
    passed = texts.mapInArrow(passing(False), packed).drop("salt")
    if len(often.value):
        folded = texts.mapInArrow(passing(True), packed).groupBy("bucket", "salt").applyInPandas(fold, "bucket int, value binary, ids binary")
        passed = passed.unionByName(folded)
    found = cut(passed.groupBy("bucket").applyInPandas(confirm, "shard bigint, value binary, owner binary, dest binary"))

    def owner_ids(batch: pa.RecordBatch) -> np.ndarray:
        return mix(_values(batch.column("owner").to_pylist(), np.int64).view(np.uint64), 9)

    owners = member_test(spark, found.select("owner"), owner_ids, rows)

    def of_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(owners(mix(batch.column("id").to_numpy().astype(np.int64).view(np.uint64), 9))))

    by_id = (F.pmod(F.col("id").cast("long"), F.lit(_PRIME)) * _FACTOR % _PRIME % shards).alias("shard")
    owning = texts.mapInArrow(of_owners, f"id {kind}, text string").select(by_id, "id", "text")

    def passages(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"shards": pa.array([], pa.list_(pa.int64())), "owner": pa.array([], pa.int64()), "passage": pa.array([], pa.binary())})
        value, owner = _values(right.column("value").to_pylist(), np.uint64), _values(right.column("owner").to_pylist(), np.int64)
        dest = np.frombuffer(b"".join(right.column("dest").to_pylist()), np.int32)
        order = np.argsort(owner, kind="stable")
        value, owner, dest = value[order], owner[order], dest[order]
        out: dict[tuple[int, bytes], list[int]] = {}
        for batch in slices(left.to_batches(), "text"):
            for to, mine, passage in passages_of(batch.column("text"), batch.column("id").to_pylist(), value, owner, dest, window):
                out.setdefault((mine, passage), []).append(to)
        places = [sorted(set(x)) for x in out.values()]
        return pa.table({"shards": pa.array(places, pa.list_(pa.int64())), "owner": pa.array([k[0] for k in out], pa.int64()), "passage": pa.array([k[1] for k in out], pa.binary())})

    # a passage is held once with the numbers of its shards, and copied to them as it is sent
    owned = owning.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(passages, "shards array<bigint>, owner bigint, passage binary")
    sent = owned.select(F.explode("shards").alias("shard"), "owner", "passage")
    sharded = everything.select(F.coalesce(by_id, F.pmod(F.xxhash64("text"), F.lit(shards))).alias("shard"), "id", "text")

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        sent = sorted(zip(right.column("owner").to_pylist(), right.column("passage").to_pylist(), strict=True))
        automata = [Phrases(p, window) for p in pieces(sent)]
        ids = left.column("id")
        out: list[tuple] = []
        for batch in slices(left.select(["id", "text"]).to_batches(), "text"):
            done = dedup_shard(batch.column("text"), batch.column("id").to_pylist(), automata)
            out += [(n, gone, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])) for n, gone, kept in done]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [ids, *(pa.array([x[k] for x in out], kinds[k]) for k in range(3 + with_text))]
        return pa.Table.from_arrays(columns, names=[id_col, "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    schema = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return sharded.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(removed, schema)
