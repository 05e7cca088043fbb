import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm.vector_codes import Book, compress_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, n int"


def brute(rows, parts=8, entries=16, rounds=6):
    """{(id, vector): (code, error, label_error, digest)} by plain loops over unbounded integers."""
    ok = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return []
    length = min(Counter(len(v) for _, v, _ in ok).items(), key=lambda x: (-x[1], x[0]))[0]
    ok = [r for r in ok if len(r[1]) == length]
    whole = lambda x: math.floor(float(x) * 4096) if abs(x) < 2**50 else int(x) * 4096
    width = -(-length // parts)
    ints = [[whole(x) for x in v] + [0] * (width * parts - length) for _, v, _ in ok]
    cut = [[tuple(z[p * width : (p + 1) * width]) for p in range(parts)] for z in ints]
    order = sorted(range(len(ok)), key=lambda n: (ok[n][0] is None, ok[n][0] or 0, ok[n][1]))[:entries]
    books = [[cut[n][p] for n in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (far(z[p], books[p][e]), e)) for p in range(parts)] for z in cut]
    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [z[p] for z, c in zip(cut, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    codes = nearest()
    errors = [sum(far(z[p], books[p][c[p]]) for p in range(parts)) for z, c in zip(cut, codes, strict=True)]
    labels = Counter()
    for (_, _, lab), e in zip(ok, errors, strict=True):
        labels[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fit = lambda e: e if e < 1 << 63 else None
    return sorted([(i, "".join(f"{x:02x}" for x in c), fit(e), fit(labels[lab]), digest) for (i, _, lab), c, e in zip(ok, codes, errors, strict=True)], key=str)


def found(spark, rows, schema=SCHEMA, **more):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], schema).repartition(3)
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in compress_vectors(df, **more).collect()], key=str)


def floats(x):
    return [float(np.float32(v)) for v in x]


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, floats(rng.normal(size=16)), int(i % 3) if i % 7 else None) for i in range(400)]
    rows += [(400 + i, floats(np.round(rng.normal(size=16))), 9) for i in range(150)]  # many ties
    rows += [(3, rows[3][1], 1), (3, rows[5][1], 1), (None, rows[8][1], 2), (900, None, 1), (901, [float("nan")] * 16, 1), (902, [1.0, None] * 8, 1), (903, [float("inf")] * 16, 1), (904, [1.0], 1), (905, [0.0] * 16, None)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("length", [1, 5, 8, 11])
def test_few_vectors_and_odd_lengths(spark, length):
    rng = np.random.default_rng(length)
    rows = [(5 * i - 20, floats(rng.normal(size=length)), i % 2) for i in range(9)] + [(7, floats([0.5] * length), 0)] * 12
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == brute(rows[:1])


def test_none_and_empty_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    assert found(spark, [(1, [], 1), (2, [], None)]) == brute([(1, [], 1), (2, [], None)])


def test_vast_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, floats(rng.normal(size=8) * 10.0 ** rng.integers(0, 30)), i % 2) for i in range(60)]
    assert found(spark, rows) == brute(rows)
    doubles = [(i, [x * 1e200 for x in v], lab) for i, v, lab in rows[:30]]
    assert found(spark, doubles, SCHEMA.replace("float", "double")) == brute(doubles)


def test_other_sizes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, floats(rng.normal(size=12)), 1) for i in range(200)]
    assert found(spark, rows, parts=3, entries=5, rounds=2) == brute(rows, 3, 5, 2)
    assert found(spark, rows, rounds=0) == brute(rows, rounds=0)


def test_bounds_spare_distances_and_lose_no_tie():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, size=(16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, size=(4000, 8))
    x[:200] = centres[3]
    entries = centres.copy()
    entries[9] = entries[3]  # the same place twice
    book = Book(entries)
    code, upper, lower = book.first(x)
    measured = 0
    for _ in range(5):
        new = entries + rng.integers(-20, 21, size=entries.shape)
        new[9] = new[3]
        book = Book(new, entries)
        code, upper, lower = book.again(x, code, upper, lower)
        entries = new
        assert (code == Book(new).first(x)[0]).all()
        far = np.sqrt(((x[:, None] - new[None]) ** 2).sum(axis=2))
        assert (upper >= far[np.arange(len(x)), code]).all() and (lower <= far).all()
        measured += book.measured
    assert measured < 0.4 * 5 * x.shape[0] * 16
