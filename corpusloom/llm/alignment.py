"""Alignment of two tokenizers by an event sweep.

Each tokenizer turns every text into end events: the byte offset at which a token ends, and its id. The
events of both are united, dealt out by document and sorted by offset, and a machine walks through them:
an offset at which tokens of both sides end closes a group, and all tokens of one side in a group are
linked to all of the other. What the machine holds is the open group, a digest and the pairs of one
document.

An event row packs the events of one side in one stretch of `STRETCH` bytes of a text, as ids alone: a
token's id gives its length, so offsets are sums. Rows of one document meet stretch by stretch, so a
very long text is never held as tokens at once.

Null and empty texts, and texts whose tokens do not spell the text with a space before it, have no
tokens: all numbers are zero and the digest of groups is ''. Repeated rows give a row each; rows that
share an id, or have none, are told apart by their text. Only the id and the text are read, so other
columns' names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import byte_chars
from .common import shared_folder
from .words import by_places, from_places, slices

#: Fixed value: how byte-level BPE of this kind splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a text whose events stand in one row.
STRETCH = 1 << 20
#: Links of groups are spread out so many at a time.
LINKS = 1 << 22

#: No token of either side spans a single space between two such characters, so a text may be encoded in pieces cut there.
_CUT = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
_EDGES = re.compile(r"[!-~À-ɏ](?s:.*[!-~À-ɏ])?\Z").match


class ByteBpe:
    """A byte-level BPE file whose merges stand in the order of their tokens' ids; special tokens' strings are plain text.

    The file's vocabulary and splitting pattern are run by a ranked merger, which is faster than the
    file's own library and gives its ids.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_chars())}
        of = {i: t for t, i in spec["model"]["vocab"].items()}
        #: the bytes of each id
        self.spelled = [b"" if i in special else bytes(back[c] for c in of[i]) for i in range(max(of) + 1)]
        self.sizes = _sizes(self.spelled)
        self.merger = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks={s: i for i, s in enumerate(self.spelled) if s}, special_tokens={})

    def ids(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text behind a space; None without a text, or where they do not spell it."""
        out = []
        for t in texts:
            ids = self.merger.encode_to_numpy(" " + t, disallowed_special=()) if t else None
            out.append(ids if t and int(self.sizes[ids].sum()) == len(t.encode()) + 1 else None)
        return out


class PieceBpe:
    """A piece model, which adds the space before a text itself.

    Texts are taken apart at spaces that no piece spans, and what stands between is remembered: `keep`
    bounds it, past which those not met since the last time are forgotten.
    """

    def __init__(self, path: str, keep: int = 120_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of this model spans a space")
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = _sizes(self.spelled)
        self.keep = keep
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _pieces(self, pieces: list[str], together: int = 64) -> list[bytes | None]:
        """Ids, as 32-bit numbers, of pieces. They are encoded `together`, as one text, and told apart by their lengths; where that text is not spelled right, one by one."""
        groups = [pieces[k : k + together] for k in range(0, len(pieces), together)]
        out = []
        for group, ids in zip(groups, self.model.encode([" ".join(g) for g in groups], num_threads=1) if groups else [], strict=True):
            raw = [x.encode() for x in group]
            if b"".join([self.spelled[i] for i in ids]) != b" " + b" ".join(raw):
                out += self._pieces(group, 1) if len(group) > 1 else [None]
                continue
            packed = np.array(ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[packed]), np.cumsum([len(x) + 1 for x in raw]), "right") * 4
            packed = packed.tobytes()
            out += [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        new = words.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        plain = [w for w in new.difference(again) if len(w) < 100 and _EDGES(w)]
        self.known.update(zip(plain, self._pieces(plain), strict=True))

    def ids(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text; None without a text, or where they do not spell it."""
        split = [t.split(" ") if t else [] for t in texts]
        self._learn(set().union(*split))
        get, out = self.known.__getitem__, []
        for text, words in zip(texts, split, strict=True):
            try:
                raw = b"".join(map(get, words)) if words else None
            except KeyError:  # other spaces, scripts at an edge or long words
                got = self._pieces(_CUT.split(text))
                raw = None if None in got else b"".join(got)
            except TypeError:  # a piece that is not spelled right
                raw = None
            out.append(None if raw is None else np.frombuffer(raw, "<u4"))
        return out


def _sizes(spelled: list[bytes]) -> np.ndarray:
    return np.array([len(s) for s in spelled], np.int64)


def end_events(docs: DataFrame, vocabulary: Callable[[], ByteBpe | PieceBpe], side: int, stretch: int = STRETCH) -> DataFrame:
    """(id, text_hash, n_bytes, at, side, times, ids): a row for each stretch of a text, its tokens those that end in it.

    `docs`: (id, text, text_hash, n_bytes). Equal rows of a batch are folded into one that stands `times` times.
    A text without tokens is one row of null ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary()
        for batch in slices(batches, "text"):
            folded: dict[tuple, list[int]] = {}
            for n, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "text_hash", "n_bytes")), strict=True)):
                folded.setdefault(key, [n, 0])[1] += 1
            texts = batch.column("text").take(pa.array([n for n, _ in folded.values()], pa.int64())).to_pylist()
            rows = []
            for (key, (_, times)), ids in zip(folded.items(), encoder.ids(texts), strict=True):
                if ids is None or key[2] < stretch:
                    rows.append((*key, 0, side, times, None if ids is None else shrunk(ids)))
                    continue
                part = (np.cumsum(encoder.sizes[ids]) - 1) // stretch
                places = np.searchsorted(part, np.arange(part[-1] + 2))  # a stretch without an end is a row, too
                rows += [(*key, n, side, times, shrunk(ids[a:b])) for n, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True))]
            kinds = [batch.schema.field("id").type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "text_hash", "n_bytes", "at", "side", "times", "ids"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, text_hash bigint, n_bytes int, at int, side int, times bigint, ids binary")


@functools.cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def shrunk(ids: np.ndarray) -> bytes:
    """Ids as 16-bit numbers where all are small enough, else 32-bit ones, compressed, behind their number and width."""
    kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    return len(ids).to_bytes(4, "little") + kind[2].encode() + _codec().compress(ids.astype(kind).tobytes(), asbytes=True)


def grown(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), raw[4:5].decode()
    return np.frombuffer(_codec().decompress(raw[5:], n * int(width), asbytes=True), f"<u{width}").astype(np.int64)


@dataclass
class Text:
    """What the machine holds of a document."""

    key: tuple
    times: int = 0
    bad: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: object = None
    groups: list = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    repeats: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    open_a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    open_b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _joined(k: np.ndarray, n: np.ndarray, more_k: np.ndarray, more_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n by key of two sorted tables."""
    if not len(k):
        return more_k, more_n
    keys, place = np.unique(np.concatenate([k, more_k]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, np.concatenate([n, more_n]))
    return keys, sums


class Sweep:
    """Walks through the events of many stretches at once."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray, with_groups: bool = False, links: int = LINKS):
        self.size_a, self.size_b, self.with_groups, self.links = size_a, size_b, with_groups, links
        self.width_b = len(size_b)
        most = len(str(max(len(size_a), len(size_b)))) + 1
        ids = np.arange(max(len(size_a), len(size_b))).astype(f"S{most}")
        self.written = {s: np.char.add(ids, s).astype(f"S{most}") for s in (b",", b"|", b";")}

    def run(self, stretches: list[tuple[Text, np.ndarray, np.ndarray]]) -> None:
        """One stretch at most of each text; what follows the last common offset stays open in it."""
        ids_a, ids_b = ([np.concatenate([t.open_a, a]) for t, a, _ in stretches], [np.concatenate([t.open_b, b]) for t, _, b in stretches])
        ends_a, ends_b = ([np.cumsum(self.size_a[x]) for x in ids_a], [np.cumsum(self.size_b[x]) for x in ids_b])
        long = np.array([max(a[-1] if len(a) else 0, b[-1] if len(b) else 0) for a, b in zip(ends_a, ends_b, strict=True)], np.int64)
        base = np.concatenate([[0], np.cumsum(long)])
        end_a = np.concatenate([e + o for e, o in zip(ends_a, base, strict=False)])
        end_b = np.concatenate([e + o for e, o in zip(ends_b, base, strict=False)])
        mark = np.zeros(int(base[-1]) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        both = mark == 3
        before = np.cumsum(both, dtype=np.int64)
        common = np.flatnonzero(both)
        group_a, group_b = before[end_a] - both[end_a], before[end_b] - both[end_b]
        text_of = np.searchsorted(base, common, "left") - 1
        first_group = np.searchsorted(text_of, np.arange(len(stretches) + 1))
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        at_a, at_b = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]) for ids in (ids_a, ids_b))
        # tokens behind the last common offset of their stretch stay open
        shut_a = group_a < np.repeat(first_group[1:], np.diff(at_a))
        shut_b = group_b < np.repeat(first_group[1:], np.diff(at_b))
        for n, (t, _, _) in enumerate(stretches):
            mine_a, mine_b = slice(at_a[n], at_a[n + 1]), slice(at_b[n], at_b[n + 1])
            t.open_a, t.open_b = a[mine_a][~shut_a[mine_a]], b[mine_b][~shut_b[mine_b]]
            t.n_a += int(shut_a[mine_a].sum())
            t.n_b += int(shut_b[mine_b].sum())
            t.n_groups += int(first_group[n + 1] - first_group[n])
        a, b, group_a, group_b = a[shut_a], b[shut_b], group_a[shut_a], group_b[shut_b]
        if not len(common):
            return
        m, n = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        self._write(stretches, a, b, group_a, group_b, m, first_group)
        self._link(stretches, a, b, m, n, text_of)

    def _write(self, stretches: list, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, m: np.ndarray, first_group: np.ndarray) -> None:
        """Adds the stretch's groups, written out, to each text's digest."""
        width = self.written[b","].dtype.itemsize
        last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
        last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
        # each token's place: those of A before B within a group
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(b)) + np.cumsum(m)[group_b]
        out = np.zeros(len(a) + len(b), f"S{width}")
        out[place_a] = np.where(last_a, self.written[b"|"][a], self.written[b","][a])
        out[place_b] = np.where(last_b, self.written[b";"][b], self.written[b","][b])
        ends = np.searchsorted(group_a, first_group) + np.searchsorted(group_b, first_group)
        for k, (t, _, _) in enumerate(stretches):
            if ends[k + 1] > ends[k]:
                part = out[ends[k] : ends[k + 1]].tobytes().replace(b"\0", b"")[:-1]  # without the last ;
                if t.digest is None:
                    t.digest = hashlib.sha256(part)
                else:
                    t.digest.update(b";" + part)
                if self.with_groups:
                    t.groups.append(part.decode())

    def _link(self, stretches: list, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, text_of: np.ndarray) -> None:
        """Adds the links of the stretch's groups to each text's pairs."""
        links = m * n
        start_a, start_b = np.cumsum(m) - m, np.cumsum(n) - n
        sums = np.cumsum(links)
        at = 0
        while at < len(links):
            before = int(sums[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sums, before + self.links, "right")))
            if to == at + 1 and links[at] > self.links:  # one vast group: distinct ids on either side and how often they stand
                one, other = a[start_a[at] : start_a[at] + m[at]], b[start_b[at] : start_b[at] + n[at]]
                (ka, ca), (kb, cb) = np.unique(one, return_counts=True), np.unique(other, return_counts=True)
                keys, times, texts = (ka[:, None] * self.width_b + kb).ravel(), (ca[:, None] * cb).ravel(), [int(text_of[at])]
                bounds = [0, len(keys)]
            else:
                each = links[at:to]
                group = np.repeat(np.arange(at, to), each)
                inner = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
                pair = a[start_a[group] + inner // n[group]] * self.width_b + b[start_b[group] + inner % n[group]]
                texts, local = np.unique(text_of[group], return_inverse=True)
                span = np.int64(len(self.size_a)) * self.width_b
                if len(texts) * int(span) < 1 << 62:
                    keys, times = np.unique(local * span + pair, return_counts=True)
                    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
                    keys = keys % span
                else:
                    order = np.lexsort((pair, local))
                    l, p = local[order], pair[order]
                    fresh = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (p[1:] != p[:-1])]))
                    keys, times = p[fresh], np.diff(np.append(fresh, len(p)))
                    bounds = np.searchsorted(l[fresh], np.arange(len(texts) + 1))
            for k, text in enumerate(texts):
                t, mine = stretches[text][0], slice(bounds[k], bounds[k + 1])
                t.pairs, t.repeats = _joined(t.pairs, t.repeats, keys[mine], times[mine])
                t.n_links += int(times[mine].sum())
            at = to


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, int, bytes | None, bytes | None]]:
    """(key, at, times, ids of A, ids of B) of sorted event rows; what stands there more than once is told once, `times` of the first stretch's A rows added up."""
    held = None
    for batch in batches:
        for id_, text_hash, n_bytes, at, side, times, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place = (id_, text_hash, n_bytes), at
            if held is None or held[0] != place:
                if held is not None:
                    yield *held[0], held[1], *held[2]
                held = [place, 0, [None, None]]
            held[2][side] = ids
            held[1] += times * (side == 0)
    if held is not None:
        yield *held[0], held[1], *held[2]


def sweep(events: DataFrame, size_a: np.ndarray, size_b: np.ndarray, with_groups: bool = False, tokens: int = 1 << 19) -> DataFrame:
    """(id, times, n_a, n_b, n_groups, n_links, groups_sha256, pairs, repeats[, groups]) of every document, from the united events of both sides.

    `pairs` are the distinct linked id pairs in order, as 64-bit numbers a * |B| + b by byte places, `repeats` how often each is linked.
    """
    kind = dict(events.dtypes)["id"]
    id_type = to_arrow_type(events.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Sweep(size_a, size_b, with_groups)

        def told(texts: list[Text]) -> pa.RecordBatch:
            digest = lambda t: t.digest.hexdigest() if t.digest is not None else ""
            columns = [(lambda t: t.key[0], id_type), (lambda t: t.times, pa.int64())]
            columns += [(lambda t, c=c: getattr(t, c), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            columns += [(digest, pa.string()), (lambda t: by_places(t.pairs), pa.binary()), (lambda t: by_places(t.repeats.astype("<u4")), pa.binary())]
            names = ["id", "times", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "repeats"]
            if with_groups:
                columns.append((lambda t: ";".join(t.groups), pa.string()))
                names.append("groups")
            return pa.RecordBatch.from_arrays([pa.array([f(t) for t in texts], k) for f, k in columns], names=names)

        text, waiting, texts, held = None, [], [], 0
        for key, at, times, a, b in _stretches(batches):
            if text is None or text.key != key:
                if held >= tokens:
                    machine.run(waiting)
                    yield told(texts)
                    waiting, texts, held = [], [], 0
                text = Text(key, times)
                texts.append(text)
                text.bad = a is None or b is None  # on the first stretch: without tokens
            if text.bad:
                continue
            if at and waiting:  # a further stretch of this text: what came before is walked first
                machine.run(waiting)
                waiting = []
            none = np.zeros(0, np.int64)
            pair = (none if a is None else grown(a), none if b is None else grown(b))
            waiting.append((text, *pair))
            held += len(pair[0]) + len(pair[1])
        if waiting:
            machine.run(waiting)
        if texts:
            yield told(texts)

    schema = f"id {kind}, times bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, repeats binary" + ", groups string" * with_groups
    together = events.repartition("id", "text_hash", "n_bytes").sortWithinPartitions("id", "text_hash", "n_bytes", "at", "side")
    return together.mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a batch, how often each is linked, and how many pairs each row has."""
    pairs = [from_places(x, np.int64) for x in batch.column("pairs").to_pylist()]
    repeats = [from_places(x, np.uint32) for x in batch.column("repeats").to_pylist()]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *pairs]), np.concatenate([none, *repeats]), np.array([len(p) for p in pairs], np.int64)


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, "pairs", 8 << 20)


def links(swept: DataFrame, width_b: int) -> DataFrame:
    """(id, a, b, n): the distinct linked id pairs of each document and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            pairs, repeats, sizes = _unpacked(batch)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(pairs // width_b), pa.array(pairs % width_b), pa.array(repeats.astype(np.int64))], names=["id", "a", "b", "n"])

    return swept.select("id", "pairs", "repeats").mapInArrow(run, f"id {dict(swept.dtypes)['id']}, a bigint, b bigint, n bigint")


def pair_counts(swept: DataFrame, most: int = 1 << 21) -> DataFrame:
    """(pair, n): how many documents hold each linked id pair. A task folds its documents, at most `most` pairs at a time, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(sums[at : at + (1 << 16)])], names=["pair", "n"])

        for batch in _by_bytes(batches):
            pairs, _, sizes = _unpacked(batch)
            times = np.repeat(batch.column("times").to_numpy(), sizes)
            order = np.argsort(pairs, kind="stable")
            pairs, times = pairs[order], times[order]
            fresh = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            if len(fresh):
                keys, sums = _joined(keys, sums, pairs[fresh], np.add.reduceat(times, fresh))
            if len(keys) > most:
                yield from told()
                keys, sums = keys[:0], sums[:0]
        yield from told()

    return swept.select("times", "pairs", "repeats").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _slices_of(counts: DataFrame, width_b: int, most: int) -> list[tuple[int, int, int]]:
    """(from, to, pairs): ranges of A ids that hold at most `most` pairs each, or one id's; as many rows as A's vocabulary has come to the driver."""
    sizes = sorted((r.a, r.n) for r in counts.groupBy(F.expr(f"pair DIV {width_b}").alias("a")).agg(F.count("*").alias("n")).collect())
    out: list[tuple[int, int, int]] = []
    for a, n in sizes:
        if out and out[-1][2] + n <= most:
            out[-1] = (out[-1][0], a + 1, out[-1][2] + n)
        else:
            out.append((a, a + 1, n))
    return out


def align(
    docs: DataFrame, vocabulary_a: Callable[[], ByteBpe], vocabulary_b: Callable[[], PieceBpe], *, id_col: str = "doc_id", text_col: str = "text",
    with_groups: bool = False, most_pairs: int = 1 << 23, stretch: int = STRETCH,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every document.

    An id pair's count is the number of documents that hold it linked; `count_sum` adds it up over a
    document's links, `n_best` counts the links whose count is the highest that their A id has anywhere.

    The swept documents are written to the shared folder once. The table of counts goes to the tasks in
    ranges of A ids of at most `most_pairs` pairs (or one id's, at most B's vocabulary), one range after
    another, each in one pass over what is left of the written pairs; so no broadcast grows with the input.
    """
    spark = docs.sparkSession
    top = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    size_a, size_b = vocabulary_a().sizes, vocabulary_b().sizes
    width_b = len(size_b)
    texts = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text", f"xxhash64(`{text_col}`) AS text_hash", f"octet_length(`{text_col}`) AS n_bytes")
    events = end_events(texts, vocabulary_a, 0, stretch).unionByName(end_events(texts, vocabulary_b, 1, stretch))

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{top}/{name}")
        return spark.read.parquet(f"{top}/{name}")

    swept = stored(sweep(events, size_a, size_b, with_groups), "swept")
    counts = stored(pair_counts(swept), "counts")
    out = swept.withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")})
    ranges = _slices_of(counts, width_b, most_pairs)
    for k, (low, high, _) in enumerate(ranges):
        some = counts.where((F.col("pair") >= low * width_b) & (F.col("pair") < high * width_b)).toArrow()
        out = _looked_up(out, some, low * width_b, high * width_b, width_b)
        if k + 1 < len(ranges):
            out = stored(out, f"looked_up_{k}")
    many = out.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    return many.select(F.col("id").alias(id_col), *columns)


def _looked_up(rows: DataFrame, counts: pa.Table, low: int, high: int, width_b: int) -> DataFrame:
    """`rows` with the counts of their pairs from `low` to `high` added up, and without these pairs."""
    keys, n = counts.column("pair").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] // width_b != keys[:-1] // width_b]))
    best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
    small = n.astype(np.uint32) if n.max() < 1 << 32 else n
    table = rows.sparkSession.sparkContext.broadcast(((keys - low).astype(np.uint32 if high - low < 1 << 32 else np.int64), small, best))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in _by_bytes(batches):
            pairs, repeats, sizes = _unpacked(batch)
            here = (pairs >= low) & (pairs < high)
            place = np.searchsorted(known, (pairs[here] - low).astype(known.dtype))
            repeated = repeats[here].astype(np.int64)
            sums = [np.zeros(len(pairs) + 1, np.int64) for _ in range(2)]
            for total, value in zip(sums, (repeated * best[place], repeated * n[place].astype(np.int64)), strict=True):
                each = np.zeros(len(pairs), np.int64)
                each[here] = value
                np.cumsum(each, out=total[1:])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            new = {c: pa.array(batch.column(c).to_numpy() + t[ends[1:]] - t[ends[:-1]]) for c, t in zip(("n_best", "count_sum"), sums, strict=True)}
            rest = [np.flatnonzero(~here[a:b]) + a for a, b in zip(ends[:-1], ends[1:], strict=True)] if not here.all() else [np.zeros(0, np.int64)] * len(sizes)
            new["pairs"] = pa.array([by_places(pairs[r]) for r in rest], pa.binary())
            new["repeats"] = pa.array([by_places(repeats[r].astype("<u4")) for r in rest], pa.binary())
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return rows.mapInArrow(run, rows.schema)
