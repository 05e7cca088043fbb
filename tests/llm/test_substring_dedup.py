import hashlib
import random
import re

import numpy as np
import pyarrow as pa

import corpusloom.llm.substring_dedup as module
from corpusloom.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id bigint, text string, words string, id string, shard int"


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    owner = {}
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                owner[k] = min(owner.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and owner[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def make(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA).repartition(3)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "the", "ñandú", "x" * 60, "q" + str(rng.randint(0, 400))])
    passages = [" ".join(word() for _ in range(n)) for n in (12, 13, 14, 27, 80, 400)]
    rows = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(130, None), (131, ""), (132, " \n"), (133, rows[3][1]), (134, rows[3][1]), (134, rows[3][1]), (5, rows[5][1]), (None, rows[3][1]), (140, "a " * 3000), (141, "a " * 40)]
    rows += [(-7, passages[5]), (150, "é" * 70000)]
    assert result(substring_dedup(make(spark, rows))) == brute(rows)


def test_small_bitmap_loses_nothing(spark):
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choice("ab") for _ in range(60))) for d in range(40)]
    assert result(substring_dedup(make(spark, rows), bits=10)) == brute(rows)


def test_empty_table_and_text(spark):
    assert result(substring_dedup(make(spark, []))) == []
    got = substring_dedup(make(spark, [(1, "a b c")]), with_text=True).collect()
    assert got[0]["kept"] == "a b c"


def mixed(seed, n=150):
    """Documents of few words with shared passages, whole and in part, and ids in steps."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "the", "q" + str(rng.randint(0, 300))])
    base = [word() for _ in range(300)]
    rows = []
    for d in range(n):
        parts = [word() for _ in range(rng.randint(0, 50))]
        a = rng.randint(0, 280)
        rows.append((d * 64, " ".join(parts + base[a : a + rng.randint(5, 60)] + [word() for _ in range(5)])))
    return rows


def test_parts_of_passages_and_ids_in_steps(spark):
    rows = mixed(9)
    assert result(substring_dedup(make(spark, rows))) == brute(rows)
    assert len(set(module.shard_of(np.arange(0, 64 * 4096, 64), 64).tolist())) == 64


def test_common_anchors_are_folded_by_salts(spark):
    rows = mixed(10) + [(100_000 + i, mixed(10)[3][1]) for i in range(40)]
    assert result(substring_dedup(make(spark, rows), hot=5)) == brute(rows)


def test_small_shards(spark):
    rows = mixed(11)
    assert result(substring_dedup(make(spark, rows), shard_bytes=400, window=7, anchor=3)) == brute(rows, 7)


def test_automata_alone_locate():
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(words[10:40]).encode()
    text = " ".join(["x"] * 9 + words[20:36] + ["y"] + words[10:22])
    n, gone, kept = next(module.dedup_shard(pa.array([text]), [7], [module.Phrases([(3, passage)], 13)]))
    assert (n, gone) == (38, 16) and kept.decode() == " ".join(["x"] * 9 + ["y"] + words[10:22])  # 12 words are no window
    assert [g for _, g, _ in module.dedup_shard(pa.array([text]), [7], [])] == [0]  # without the automaton nothing is found
    assert [g for _, g, _ in module.dedup_shard(pa.array([text] * 3), [3, 2, None], [module.Phrases([(3, passage)], 13)])] == [0, 0, 0]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(module.Words, "hashes", lambda self: np.full(len(self.starts), 5, np.uint64))
    found = [module.Phrases([(1, b" ".join(b"p%d" % i for i in range(20)))], 13)]
    texts = pa.array([" ".join(f"p{i}" for i in range(20)), " ".join(f"r{i}" for i in range(20))])
    assert [g for _, g, _ in module.dedup_shard(texts, [5, 6], found)] == [20, 0]


def test_long_passages_come_in_pieces():
    text = " ".join(f"w{i}" for i in range(100))
    w = module.Words(pa.array([text]))
    value, _ = w.windows(w.hashes(), 13)
    n = 88
    got = list(module.passages_of(pa.array([text]), [4], value[:n], np.full(n, 4), np.zeros(n, np.int32), 13, longest=30))
    found = [module.Phrases(p, 13) for p in module.pieces([(o, p) for _, o, p in got], most=60)]
    assert len(found) > 1
    assert next(module.dedup_shard(pa.array([text]), [9], found))[1] == 100
