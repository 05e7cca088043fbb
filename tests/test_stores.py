"""Shards, the token stream, stored keys, bounded streams, block-max search and topics as a table."""

import gzip
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import blockmax, budget, grounding, seen, tokenstream
from corpusloom.sources import shards
from corpusloom.streaming import live


def files(path, prefix="korpus_"):
    return {f.name: [json.loads(x) for x in gzip.open(f, "rt", encoding="utf-8")] for f in sorted(path.glob(f"{prefix}*.jsonl.gz"))}


def test_shards_are_full_and_numbered_on(spark, tmp_path):
    out = tmp_path / "corpus"
    df = spark.range(53).select("id", F.concat(F.lit("metin ş "), "id").alias("metin"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n")).repartition(6)
    bucket = lambda d: budget.range_bucket(d, "id", 7, per_bucket=1)
    assert shards.write_shards(df, str(out), "id", bucket(df), 20) == 3
    got = files(out)
    assert list(got) == [f"korpus_{i:04d}.jsonl.gz" for i in (1, 2, 3)] and [len(x) for x in got.values()] == [20, 20, 13]
    assert [r["id"] for x in got.values() for r in x] == list(range(53)) and got["korpus_0001.jsonl.gz"][1] == {"id": 1, "metin": "metin ş 1", "n": None}
    more = df.where("id < 40")
    assert shards.write_shards(more, str(out), "id", bucket(more), 20) == 2 and list(files(out))[3:] == ["korpus_0004.jsonl.gz", "korpus_0005.jsonl.gz"]
    assert shards.write_shards(df.limit(0), str(out), "id", F.lit(0), 20) == 0
    assert shards.read_shards(spark, str(out), "id long, metin string").count() == 93
    assert [p.name for p in out.iterdir() if not p.name.endswith(".jsonl.gz")] == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = tmp_path / "corpus"
    df = spark.range(30)
    shards.write_shards(df, str(out), "id", F.lit(0), 10)
    rows = spark.range(40).select((F.col("id") / 10 + 4).cast("int").alias("shard"))
    bad = rows.select("shard", F.format_string("korpus_%04d.jsonl.gz", "shard").alias("name"), F.when(F.col("shard") < 7, F.lit("{}")).otherwise(F.raise_error(F.lit("broken row"))).cast("string").alias("record"))
    with pytest.raises(Exception, match="broken row|USER_RAISED"):
        bad.repartition(4, "shard").sortWithinPartitions("shard").write.format("jsonshards").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"korpus_{i:04d}.jsonl.gz" for i in (1, 2, 3)]
    twice = spark.createDataFrame([(1, "korpus_0002.jsonl.gz", "{}")], "shard int, name string, record string")
    with pytest.raises(Exception, match="there already"):
        twice.write.format("jsonshards").mode("append").save(str(out))
    assert len(files(out)["korpus_0002.jsonl.gz"]) == 10 and len(list(out.iterdir())) == 3


@pytest.mark.parametrize("width", [7, 64, 1 << 16])
def test_token_stream(spark, tmp_path, width):
    rng = random.Random(width)
    docs = [(i, [rng.randrange(1 << 16) for _ in range(rng.choice([0, 1, 3, 20, 90]))]) for i in range(60)]
    df = spark.createDataFrame([*docs, (60, None)], "id int, ids array<int>").repartition(4)
    flat = [t for _, ids in docs for t in ids]
    stream = tokenstream.token_stream(df, F.col("ids"), "id", budget.range_bucket(df, "id", 5, per_bucket=1), width)
    assert tokenstream.write_token_stream(stream, f"{tmp_path}/s", width) == len(flat)
    stored, total, stored_width = tokenstream.read_token_stream(spark, f"{tmp_path}/s")
    assert (total, stored_width) == (len(flat), width)
    parts = sorted((r.stretch, r.ids) for r in stored.collect())
    assert [t for _, ids in parts for t in ids] == flat and all(len(ids) == width for _, ids in parts[:-1])
    starts = [(w, rng.randrange(-3, len(flat) + 3)) for w in range(150)] + [(900, 0), (901, len(flat) - 26), (902, len(flat) - 25)]
    got = {r.window: (r.x, r.y) for r in tokenstream.stream_windows(stored, spark.createDataFrame(starts, "window int, start int"), 25, width).collect()}
    assert got == {w: (flat[s : s + 25], flat[s + 1 : s + 26]) for w, s in starts if 0 <= s and s + 26 <= len(flat)}
    with pytest.raises(Exception, match="16 bits"):
        tokenstream.write_token_stream(spark.createDataFrame([(0, 1, [1 << 16])], "stretch long, n int, ids array<int>"), f"{tmp_path}/w")
    assert tokenstream.write_token_stream(tokenstream.token_stream(df.limit(0), F.col("ids"), "id", F.lit(0), width), f"{tmp_path}/none", width) == 0


@pytest.mark.parametrize("how", [{}, {"per_file": 20}, {"per_file": 20, "broadcast_bytes": 0}, {"per_file": 50, "most_runs": 2}])
def test_runs_over_parts_equal_one_run(spark, tmp_path, how):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(260)}", i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, text string, part int").repartition(4)
    store, want, seen_texts = seen.KeyStore(spark, f"{tmp_path}/store", **how), [], set()
    for part in range(5):
        fresh = store.write_fresh(df.where(F.col("part") == part), F.col("text"), ["id"], f"{tmp_path}/out", str(part))
        first = {}
        for i, t, _ in rows:
            if i % 5 == part and t not in seen_texts:
                first.setdefault(t, i)
        seen_texts |= set(first)
        want += first.values()
        assert sorted(r.id for r in fresh.collect()) == sorted(first.values())
        again = store.write_fresh(df.where(F.col("part") == part), F.col("text"), ["id"], f"{tmp_path}/out", str(part))
        assert sorted(r.id for r in again.collect()) == sorted(first.values())
    assert sum(r[1] for r in store.runs()) == len(want) and len(store.runs()) <= how.get("most_runs", 8) + 1


def test_few_files_are_opened_and_interrupted_runs_are_harmless(spark, tmp_path, monkeypatch):
    store = seen.KeyStore(spark, f"{tmp_path}/store", per_file=100)
    key = F.unhex(F.md5(F.col("id").cast("string"))).alias("key")
    store.add(spark.range(5000).select(key), "a")
    assert {r.key for r in store.known(spark.range(4998, 5003).select(key)).collect()} == {r.key for r in spark.range(4998, 5000).select(key).collect()}
    assert store.files >= 32 and store.opened <= 4
    store.known(spark.range(9000, 9003).select(key))
    assert store.opened <= 1
    with monkeypatch.context() as m:  # killed behind the rows, before the keys are live
        m.setattr(store, "_commit", lambda runs: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.write_fresh(spark.range(4990, 5010).select("id", F.col("id").cast("string").alias("t")), F.col("t"), ["id"], f"{tmp_path}/out", "b")
    again = store.write_fresh(spark.range(4990, 5010).select("id", F.col("id").cast("string").alias("t")), F.col("t"), ["id"], f"{tmp_path}/out", "b")
    assert sorted(r.id for r in again.collect()) == list(range(5000, 5010)) and sum(r[1] for r in store.runs()) == 5010


def test_blooms_never_miss():
    rng = np.random.default_rng(1)
    keys = [rng.bytes(16) for _ in range(3000)]
    filter_ = seen.bloom(keys[:1000])
    assert seen.may_hold(filter_, keys[:1000]).all() and seen.may_hold(filter_, keys[1000:]).mean() < 0.03


def test_a_bounded_read_survives_restarts(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(8):
        spark.createDataFrame([(f"{i}{j}" * 10,) for j in range(3)], "text string").coalesce(1).write.parquet(f"{src}/f{i}")
    read = lambda: spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    until = lambda name, target: live.read_until(read(), f"{tmp_path}/{name}", f"{tmp_path}/{name}-ck", text_col="text", target_bytes=target)
    texts = lambda name: sorted(r.text for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert until("one", 200) == 240 == until("one", 200) and len(texts("one")) == 12
    assert until("two", 100) == 120 and until("two", 200) == 240 and texts("two") == texts("one")
    assert until("all", 10_000) == 480 and len(texts("all")) == 24

    true, tries = spark.createDataFrame, []

    def killed(*a, **k):
        if len(a) > 1 and a[1] == "batch bigint, bytes bigint":
            tries.append(a[0][0][0])
            if len(tries) in (2, 4):
                raise RuntimeError("killed between rows and log")
        return true(*a, **k)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: killed(*a, **k))
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            until("three", 200)
    assert until("three", 200) == 240
    monkeypatch.undo()
    assert texts("three") == texts("one")


def bm25(docs, queries, k):
    words = lambda t: re.findall("[a-z0-9_]+", t.lower())
    tf = {i: Counter(words(t)) for i, t in docs}
    n, average = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if r < 0 else r for w, r in raw.items()}
    out = {}
    for q, t in queries:
        scores = {}
        for i, c in tf.items():
            hits = [w for w in words(t) if w in c]
            if hits:
                scores[i] = round(sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average)) for w in hits), 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        if best:
            out[q] = [(i, s) for i, s in best]
    return out


@pytest.mark.parametrize("per_block,first", [(4, 5), (16, 3), (1000, 1)])
def test_search_of_many_queries(spark, tmp_path, per_block, first):
    rng = random.Random(per_block)
    vocabulary = [["der", "haus", "und", *(f"d{i}" for i in range(60))], ["the", "house", "and", *(f"e{i}" for i in range(60))]]
    docs = [(i, " ".join(rng.choice(vocabulary[i % 2][:3] * 8 + vocabulary[i % 2]) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    queries = [(q, docs[rng.randrange(300)][1][: rng.randint(5, 120)]) for q in range(25)] + [(90, "zzz"), (91, ""), (92, "the the der d1"), (93, None)]
    d = spark.createDataFrame([(i, t, i % 2) for i, t in docs], "id int, t string, lang int").repartition(3)
    index = blockmax.block_index(d, "id", "t", F.col("lang"), per_block)
    blockmax.write_block_index(index, f"{tmp_path}/i")
    best, report = blockmax.search_many(blockmax.read_block_index(spark, f"{tmp_path}/i"), spark.createDataFrame(queries, "q int, text string"), "q", "text", 5, first)
    got = {}
    for r in sorted(best.collect(), key=lambda r: (r.query, r.rank)):
        got.setdefault(r.query, []).append((r.id, round(r.score, 6)))
    want = bm25(docs, [q for q in queries if q[1]], 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)
    sums = report.agg(F.sum("blocks"), F.sum("scored")).first()
    assert sums[1] <= sums[0] and (per_block != 4 or sums[1] < 0.9 * sums[0])


def test_topics_as_a_table(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 80))) for _ in range(120)] + [None, "", "İstanbul AND 😀 smile"]
    keywords = sorted({t[a : a + rng.randint(1, 9)] for t in texts if t for a in range(0, len(t), 9)}) + ["zz", "q", "", "and 😀"]
    topics = [(f"s{i % 40}", k.upper() if i % 3 else k) for i, k in enumerate(keywords)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    mapping = {}
    for slug, k in topics:
        if k:
            mapping.setdefault(slug, []).append(k.lower())
    more = dict(id_col="id", text_col="text", per_topic=4, max_chars=30, order=["id"])
    want = sorted(map(tuple, grounding.ground_topics(docs, mapping, **more).collect()))
    assert sorted(map(tuple, grounding.ground_table(docs, spark.createDataFrame(topics, "slug string, keyword string"), **more).collect())) == want
    assert grounding.ground_table(docs, spark.createDataFrame([], "slug string, keyword string"), **more).count() == 0
