"""Vectorised word handling over Arrow text columns.

A word is a run of bytes other than the six ASCII white-space bytes (0x20, 0x09-0x0D), so UTF-8
characters are never split. Everything works on the raw UTF-8 buffer of a batch with numpy: no
Python object is made per word. Null texts have no words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG = 48  # words of more bytes are hashed one by one


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of every text in a string array: byte spans, hashes and the first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
        self.texts = texts
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.data = LOWER[data] if lower else data
        inside = ~SEP[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        a, b = self.offsets[:-1], self.offsets[1:]
        full = b > a
        first[a[full]] = inside[a[full]]
        last[b[full] - 1] = inside[b[full] - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: words of text i are first_word[i] .. first_word[i + 1]
        self.first_word = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first_word)

    @property
    def doc(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        lens = self.ends - self.starts
        order = np.argsort(-np.minimum(lens, _LONG + 1).astype(np.int8), kind="stable")
        lens_o, starts_o = lens[order], self.starts[order]
        h = np.full(len(order), 0x51ED270B, np.uint64)
        many = int(np.searchsorted(-np.minimum(lens_o, _LONG + 1), -_LONG, "left"))  # longer than _LONG
        ranked = -np.minimum(lens_o, _LONG + 1)
        for j in range(_LONG):
            k = int(np.searchsorted(ranked, -j, "left"))
            if not k:
                break
            h[:k] = h[:k] * _BASE + self.data[starts_o[:k] + j]
        h = mix(h ^ (lens_o.astype(np.uint64) << np.uint64(48)))
        for i in range(many):
            s = int(starts_o[i])
            h[i] = int.from_bytes(hashlib.blake2b(self.data[s : s + int(lens_o[i])].tobytes(), digest_size=8).digest(), "little")
        out = np.empty(len(order), np.uint64)
        out[order] = h
        return out

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position, and the positions where k words of one text begin."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        w = hashes[:n].copy()
        for j in range(1, k):
            w = w * _BASE + hashes[j : j + n]
        return mix(w, k), np.flatnonzero(self.windows_inside(k))

    def windows_inside(self, k: int) -> np.ndarray:
        doc = self.doc
        return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def by_places(x: np.ndarray) -> bytes:
    """The bytes of integers, place by place: the upper places of sorted or small ones are runs, which a shuffle's compression folds."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_places(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only


def release() -> None:
    """Give free memory back to the system, so that a worker waiting for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `max_bytes`, or one text if that is longer. Memory is released behind the last."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def sorted_unique(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs, by doc and then value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]
