import hashlib
import random

import pytest
from tokenizers import Tokenizer

from corpusloom.llm.bpe import Encoder, bpe_encode
from corpusloom.llm.queries import vocabulary

TEXTS = [
    "Hello’s İSTANBUL ΣΑΣ ﬁ x\x1cy\x85z  a<|endoftext|>b it's I'LL x_y __ 1² ½ ŉ ſ ß ﻿ \U0001f600 日本語 á \x00",
    "", "   ", "zq" * 300, "ªºµ", "".join(chr(i) for i in range(32, 0x250)), "a­b", "don't'sx'", "x" * 2000, "the end." * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_equals_the_library(library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab'stre DL01 _-!é§ſŉµßÄ ªº²\n\tİΣ<|>endoftext") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    e = Encoder(vocabulary(), keep=50)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == (" ".join(map(str, want)), library.decode(want, skip_special_tokens=False)), t[:50]


def test_cuts_are_forced():
    e = Encoder(vocabulary())
    word = "theʐthe"
    mapped = "".join(e.chars[b] for b in word.encode())
    parts = e.fragments(mapped)
    assert "".join(parts) == mapped
    assert all(a[-1] + b[0] not in e.joined for a, b in zip(parts, parts[1:], strict=False))


def test_query(spark, library):
    rows = [(i, t, "clash", 0) for i, t in enumerate(TEXTS)] + [(99, None, "x", 1), (1, "twice", "x", 2), (1, "twice", "x", 2), (None, "no id", None, None)]
    out = bpe_encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids_sha256 string, n_tokens int").repartition(3), vocabulary(), with_ids=True).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(TEXTS):
        if i != 1:
            want = library.encode(t, add_special_tokens=False).ids
            assert by[i].n_tokens == len(want) and by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert by[99].n_tokens == 0 and by[99].ids == "" and by[None].n_tokens > 0
    assert bpe_encode(spark.createDataFrame([], "doc_id bigint, text string"), vocabulary()).count() == 0
