"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that stands side by side inside no vocabulary token can be joined by no merge, so a text
may be cut there. Word boundaries of the tokenizer's own splitting are such cuts; `Encoder` finds the
others from the vocabulary, encodes each fragment on its own and concatenates the ids. Merges never
reach across a forced cut, so the result equals that of the whole word.

Null and empty texts have no tokens; the decoded text is then empty.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

#: Texts of these characters only are split here; any other goes through the library's own normaliser and splitter.
_PLAIN = re.compile(r"[\t\n\r -~¡-©«-±´¶-¸»¿-ſ]*")
_PLAIN_WORDS = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|(?:[^\s\w]|_)+")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes are themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


class Encoder:
    """Encodes and decodes with a byte-level BPE vocabulary file whose words carry an end-of-word suffix.

    `keep` bounds the fragments remembered per worker; past it the memory is emptied and filled anew.
    """

    def __init__(self, path: str, keep: int = 150_000):
        from tokenizers import Tokenizer, models

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokenizer = Tokenizer.from_file(path)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        #: two models over one vocabulary: a word's last fragment gets the suffix, others do not
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        inner = [m for m in merges if not m[1].endswith(self.suffix)] if self.suffix else merges
        self.inner = models.BPE(vocab=model["vocab"], merges=inner)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.chars = byte_chars()
        end = len(self.suffix)
        bare = (t[:-end] if end and t.endswith(self.suffix) else t for t in model["vocab"])
        self.joined = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        self.keep = keep
        self.word_memory: dict[str, tuple[str, str]] = {}
        self.chunk_memory: dict[str, tuple[str, str]] = {}

    def fragments(self, word: str) -> list[str]:
        """A word, in stand-in characters, cut between every two bytes that no token joins."""
        if self.joined.issuperset(map(add, word, word[1:])):
            return [word]
        at = [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.joined]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]

    def encode_word(self, word: str) -> tuple[str, str]:
        """Ids and tokens of a word in stand-in characters, each joined by spaces."""
        *before, end = self.fragments(word)
        tokens = [t.as_tuple() for t in self.last.tokenize(end)]
        if before:
            tokens = [t.as_tuple() for p in before for t in self.inner.tokenize(p)] + tokens
        return " ".join([str(t[0]) for t in tokens]), " ".join([t[1] for t in tokens])

    def _remember(self, memory: dict, key: str, value: tuple[str, str]) -> tuple[str, str]:
        if len(memory) >= self.keep:
            memory.clear()
        memory[key] = value
        return value

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """A run of plain text without white space; its words are remembered, and so is the whole."""
        out = []
        for w in _PLAIN_WORDS.findall(chunk):
            if (x := self.word_memory.get(w)) is None:
                x = self._remember(self.word_memory, w, self.encode_word("".join([self.chars[b] for b in w.encode()])))
            out.append(x)
        return self._remember(self.chunk_memory, chunk, out[0] if len(out) == 1 else (" ".join([x[0] for x in out]), " ".join([x[1] for x in out])))

    def _piece(self, text: str) -> list[tuple[str, str]]:
        if _PLAIN.fullmatch(text):
            get, chunks = self.chunk_memory.get, text.lower().split()
            out = [get(c) for c in chunks]
            if None in out:
                out = [x or get(c) or self._chunk(c) for x, c in zip(out, chunks, strict=True)]
            return out
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [self.encode_word(w) for w, _ in split]

    def encode(self, text: str | None) -> tuple[str, str]:
        """The ids and the decoded text: both joined by single spaces, as the vocabulary has no decoder of its own."""
        if not text:
            return "", ""
        if self.split_special is None or not any(s in text for s in self.special):
            found = self._piece(text)
        else:
            found = []
            for part in self.split_special.split(text):
                found += [(str(self.special[part]), part)] if part in self.special else self._piece(part) if part else []
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


def bpe_encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every text. No shuffle.

    `vocabulary` is the path of a tokenizer file, on every machine. Other columns of `docs` are not
    read, so their names cannot clash. Repeated ids give a row each; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches, "text"):
            rows = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("id"),
                pa.array([a.count(" ") + 1 if a else 0 for a, _ in rows], pa.int64()),
                pa.array([sha(a) for a, _ in rows], pa.string()),
                pa.array([sha(b) for _, b in rows], pa.string()),
            ]
            if with_ids:
                columns += [pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)
