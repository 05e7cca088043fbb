import numpy as np
import pytest

from corpusloom.llm.nearest import hadamard, nearest

SCHEMA = "vec_id bigint, embedding array<float>, score double, rank int, v string"


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            near = sorted(((-float(q @ v), j) for j, v in ok if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1.0, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    out = {}
    for r in sorted(nearest(df, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x[700:1000] = x[5]  # a crowd of equal vectors
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, None] * 12), (2080, [1.0]), (None, rows[3][1]), (20, rows[20][1])]
    want, got = brute([r for r in rows if r[1] is None or len(r[1]) != 1]), found(spark, rows, block_rows=100)
    assert set(want) == set(got)
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert len(near) == 20 and [(-s, j) for j, s in near] == sorted((-s, j) for j, s in near)
    assert [j for j, _ in got[700]] == [5, *range(701, 720)]
    assert got[700] == [(j, s) for j, s in got[700]] and np.allclose([s for _, s in got[700]], [s for _, s in want[700]])


def test_few_and_none(spark):
    assert found(spark, []) == {}
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [-1.0, 0.5, 0.0])]
    assert [j for j, _ in found(spark, rows)[0]] == [1, 2]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def unit(rng, n, dim=64):
    x = rng.normal(size=(n, dim))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


def recall(want, got):
    return sum(len({j for j, _ in want[q]} & {j for j, _ in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("n", [1, 12, 21, 30, 500, 2000])
def test_defaults_at_every_size(spark, n):
    rows = unit(np.random.default_rng(n), n)
    want, got = brute(rows), found(spark, rows)
    if n > 1:
        assert recall(want, got) >= 0.9
    for q, near in got.items():
        assert len(near) == min(20, n - 1)
    if n <= 21:
        assert {q: [j for j, _ in near] for q, near in got.items()} == {q: [j for j, _ in near] for q, near in want.items() if near}


def test_more_axes_a_table(spark):
    rows = unit(np.random.default_rng(1), 3000, 16)
    want, got = brute(rows), found(spark, rows, axes=2)
    assert recall(want, got) >= 0.9
    assert recall(want, found(spark, rows, bucket_rows=1)) >= 0.9


def test_ties_go_by_id_and_doubles_are_not_rounded(spark):
    rows = [(i, [1.0 if j == i % 8 else 0.0 for j in range(8)]) for i in range(200)]
    assert found(spark, rows, block_rows=30) == brute(rows)
    near = [1.0, 1e-12, 0.0]
    df = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (1, [1.0, 0.0, 0.0]), (2, near)], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in sorted(nearest(df).collect(), key=lambda r: r.rank) if r.query_id == 0] == [(2, 1.0 + 1e-12), (1, 1.0)]


def test_lengths_that_tie(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (20, [0.0, 1.0, 0.0])]
    assert found(spark, rows) == brute(rows[:2])
