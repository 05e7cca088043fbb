import hashlib
import math
from collections import Counter

import pytest

from corpusloom.llm.mixing import mix_sources

SCHEMA = "doc_id bigint, text string, source string, replica int, _rate double"


def poisson(doc, rate, seed="mix"):
    u = int(hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()[:8], 16) / 2**32
    n, c = 0, math.exp(-rate)
    while c <= u:
        n += 1
        c += math.exp(-rate) * rate**n / math.factorial(n)
    return n


def docs(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else f"small{i % 3}", 7, 0.5) for i in range(3000)]
    rows += [(5000, None, None, 1, None), (5001, "", None, 1, None), (5002, "twice", "big", 1, None), (5002, "twice", "big", 1, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def test_counts_follow_the_inverted_distribution(spark):
    df, rows = docs(spark)
    got = mix_sources(df, with_order=False)
    assert got.columns == df.columns
    size = Counter(r[2] for r in rows)
    wanted = sum(math.sqrt(n) for n in size.values())
    rate = {s: len(rows) * math.sqrt(n) / wanted / n for s, n in size.items()}
    want = Counter()
    for d, _, s, *_ in rows:
        want[d] += poisson(d, rate[s])
    assert Counter(r.doc_id for r in got.collect()) == +want


def test_weights_order_and_reruns(spark):
    df, rows = docs(spark)
    df = df.select("doc_id", "text", "source")
    weights = {"big": 1.0, "small0": 1.0, None: 0.0}
    a = mix_sources(df, weights=weights, epochs=0.5).collect()
    b = mix_sources(df.repartition(7), weights=weights, epochs=0.5).collect()
    assert {(r.doc_id, r.replica) for r in a} == {(r.doc_id, r.replica) for r in b}
    share = Counter(r.source for r in a)
    assert set(share) == {"big", "small0"} and 0.8 < share["small0"] / share["big"] < 1.25
    with pytest.raises(ValueError):
        mix_sources(df, weights={"small0": 1.0}, most_rate=5)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA), with_order=False).count() == 0


def test_rates_that_underflow(spark):
    rows = [(d, "t", "large", 0, 0.0) for d in range(1800)] + [(5000 + d, "t", "single", 0, 0.0) for d in range(2)]
    got = Counter(r.doc_id for r in mix_sources(spark.createDataFrame(rows, SCHEMA), weights={"single": 1.0}, with_order=False).select("doc_id").collect())
    want = {}
    for d in (5000, 5001):
        u, rate = int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:8], 16) / 2**32, 901.0
        n, c = 0, math.exp(-rate)
        while c <= u:
            n += 1
            c += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        want[d] = n
    assert got == want


def test_clashing_names_are_written_and_read(spark, tmp_path):
    rows = [(d, "t", f"s{d % 3}", 1, "k", 2.5, "dotted") for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, Replica int, mix_key string, _row double, `a.b` string")
    mix_sources(df).write.parquet(f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == ["doc_id", "text", "source", "Replica", "mix_key", "_row", "a.b", "replica_", "mix_key_"]
    assert {(r.Replica, r.mix_key, r["a.b"]) for r in back.collect()} == {(1, "k", "dotted")}


def test_very_long_texts(spark):
    rows = [(i, "long " * 400_000 if i == 3 else f"t{i}", f"s{i % 2}", 0, 0.0) for i in range(40)]
    out = mix_sources(spark.createDataFrame(rows, SCHEMA), epochs=3.0, with_order=False).collect()
    assert {len(r.text) for r in out if r.doc_id == 3} <= {2_000_000} and len(out) > 40
