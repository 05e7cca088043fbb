import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpusloom.llm.ngram_join as module
from corpusloom.llm.ngram_join import ngram_components
from corpusloom.llm.sketch import Counts
from corpusloom.llm.words import from_places

SCHEMA = "doc_id bigint, text string, n bigint, component string, id int"


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k=3, percent=90):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def check(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, ngram_components(df, **more).collect())) == brute(rows, more.get("k", 3), more.get("percent", 90))


def corpus(seed, n_base=25, copies=7):
    rng = random.Random(seed)
    rows, d = [], 0
    for _ in range(n_base):
        words = [rng.choice("the of A b c d e f g h".split()) + str(rng.randint(0, 9)) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 40, 120, 300]))]
        for _ in range(rng.randint(1, copies)):
            w = list(words)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(["X", "the", "zz" + str(rng.randint(0, 99))])
            rows.append((rng.randint(0, 10) * 1000 + (d := d + 1), " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1) + [(900001, None), (900002, ""), (900003, " \n"), (900004, "one"), (900005, "ONE"), (900006, "é" * 50000)]
    check(spark, rows)


def test_large_groups_and_full_tables(spark):
    rows = corpus(2, n_base=3, copies=60)
    check(spark, rows, small=4, rare=6)
    check(spark, rows, small=2, bits=8, rare=4)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None)])


def test_near_copies_in_a_chain_and_stragglers(spark):
    """Documents that share most of a base, too far from each other to be one component, and a crowd of exact copies."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for d in range(60):
        w = list(base)
        for i in rng.sample(range(120), rng.choice([1, 2, 3, 5, 8])):
            w[i] = rng.choice(["zz", f"y{rng.randint(0, 5)}", f"x{d}"])
        rows.append((100 + d, " ".join(w)))
    for d in range(30):  # each a few words on from the last
        rows.append((200 + d, " ".join(f"c{i}" for i in range(d * 2, d * 2 + 100))))
    check(spark, rows, small=3, rare=3)
    check(spark, rows, small=3, rare=3, bits=6, shared_least=1)


def test_one_id_with_two_texts(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(7, " ".join(words)), (7, "other words altogether here"), (3, " ".join(words + ["more"])), (9, "other words altogether here"), (None, " ".join(words))]
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA)
    got = sorted(map(tuple, ngram_components(df).collect()), key=str)
    assert got == sorted([(7, 48, 3), (7, 2, 7), (3, 49, 3), (9, 2, 7), (None, 48, None)], key=str)


def test_pairs_must_meet_under_all_orders_before_texts_move(spark, monkeypatch):
    verified, met = set(), {0: set(), 1: set(), 2: set()}
    links, meetings = module.links, module.meetings

    def spied_links(found, texts, *more):
        verified.update((r.x, r.y) for r in found.collect())
        return links(found, texts, *more)

    def spied_meetings(*args):
        out = meetings(*args)
        for r in out.where("token IS NULL").collect():
            met[r.kind].add((r.x, r.y))
        return out

    monkeypatch.setattr(module, "links", spied_links)
    monkeypatch.setattr(module, "meetings", spied_meetings)
    rng = random.Random(2)
    rows = [(d, " ".join(f"w{rng.randint(0, 8)}" for _ in range(60))) for d in range(120)] + [(500 + d, " ".join(f"v{i}" for i in range(50 + d))) for d in range(3)]
    check(spark, rows, bits=5, shared_least=1, small=200)
    assert verified == met[0] & met[1] & met[2]
    assert 3 <= len(verified) < len(met[0]) / 4


def test_counts_past_16_bits(spark):
    from corpusloom.llm.sketch import count_cells

    df = spark.range(75_000).selectExpr("cast(7 AS bigint) AS v").coalesce(1)
    counts = count_cells(df, lambda b: iter([[b.column("v").to_numpy().astype(np.uint64) << np.uint64(60)]]), 12)[0]
    assert counts.max() == 75_000 and counts.sum() == 75_000


@pytest.mark.parametrize("k,percent", [(1, 50), (1, 30), (2, 40), (3, 60), (5, 80), (2, 95), (4, 35)])
def test_other_sizes_and_thresholds(spark, k, percent):
    rng = random.Random(100 * k + percent)
    rows = corpus(k * percent, n_base=14, copies=5) + [(990_000, "a b"), (990_001, "a"), (990_002, "c d e f"), (990_003, "c d")]
    rows += [(991_000 + i, " ".join(rng.choice("pqrstuvw") for _ in range(rng.randint(1, 9)))) for i in range(40)]
    check(spark, rows, k=k, percent=percent, **({"small": 2, "rare": 3} if k % 2 else {}))


def test_vast_groups_are_dealt_out(spark):
    rng = random.Random(77)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(160):
        w = list(base)
        for i in rng.sample(range(60), rng.choice([0, 1, 2, 3])):
            w[i] = f"x{d}"
        rows.append((d, " ".join(w)))
    check(spark, rows, vast=20, small=4)


def test_names_that_clash(spark, monkeypatch):
    true = module.class_keys

    def narrow(doc, tokens, count, clashes=None):
        keys = true(doc, tokens, count)
        keys[:, 0] %= 5
        if clashes is not None and len(clashes):
            twice = np.isin(keys[:, 0], clashes)
            keys[twice, 0] = keys[twice, 1]
        return keys

    monkeypatch.setattr(module, "class_keys", narrow)
    check(spark, corpus(5, n_base=10))


class Taken:
    """Takes the place of a table of prefixes, and keeps the function that would deal them out."""

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        self.dealt = f
        return self

    def groupBy(self, *columns):  # noqa: N802
        return self

    def applyInPandas(self, f, schema):  # noqa: N802
        return self


def test_a_batch_of_prefixes_is_dealt_out_in_pieces():
    """Memory of a worker follows the piece, not the batch, of which the rows and their prefixes may be any number; no token is lost."""
    rows, per = 10_000, 80  # 6.4 MB
    tokens = np.random.default_rng(1).integers(0, 2**63, (rows, per), np.uint64)
    batch = pa.RecordBatch.from_pydict({"c": pa.array(range(rows), pa.int64()), "n": pa.array([per] * rows, pa.int64()), "kind": pa.array([0] * rows, pa.int32()), "first": pa.array([x.tobytes() for x in tokens], pa.binary())})
    taken = module.meetings(Taken(), 8, 8, 3, 80, lambda t: np.zeros(len(t), np.int64), 50_000)
    found = 0
    tracemalloc.start()
    try:
        for part in taken.dealt(iter([batch])):
            for ids, raw in zip(part.column("ids").to_pylist(), part.column("token").to_pylist(), strict=True):
                ids, own = from_places(ids, np.int64), from_places(raw, np.uint64)
                assert (tokens[ids] == own[:, None]).any(axis=1).all()
                found += len(own)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == rows * per
    assert peak < 40 << 20


def test_counts_beyond_16_bits_are_kept():
    counts = np.array([0, 1, 65534, 65535, 65536, 2**32 - 1, 7], np.uint32)
    held = Counts(counts)
    cell = np.array([5, 0, 6, 4, 3, 2, 1, 5])
    assert held[cell].tolist() == counts[cell].tolist()
    assert held[np.zeros(0, np.int64)].tolist() == []
    assert Counts(np.arange(1 << 16, dtype=np.uint32)).low.nbytes == 1 << 17
