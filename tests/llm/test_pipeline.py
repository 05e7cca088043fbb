import hashlib
import random

import pytest

import corpus_pipeline as P
from corpusloom.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = []
    for d in range(160):
        text = " ".join(word() for _ in range(rng.randint(60, 200)))
        rows.append([d, text, "en", f"s{d % 3}"])
    rows += [[200 + i, rows[i][1], "en", "s9"] for i in range(10)]  # copies
    rows += [[300 + i, "short text", "en", "s1"] for i in range(5)]
    rows += [[400, " ".join(["same"] * 200), "en", "s0"], [401, None, None, None], [402, "", "en", "s0"]]
    rows += [[500, rows[20][1] + ' password = "k9Xf27Qz81Lm" end', "en", "s2"]]
    rows += [rows[30], rows[30]]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).repartition(4)


def test_stages_and_run(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        d = stage(spark, d, str(tmp_path))
        assert set(d.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        d.write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(d.collect())
    ids = [sorted(r.doc_id for r in k) for k in kept]
    assert not {300, 400, 401, 402} & set(ids[0]) and set(range(160)) <= set(ids[0])
    assert ids[1] == list(range(160))  # 500 is near 20; copies and repeated rows go
    assert ids[2] == ids[1]
    last = {r.doc_id: r.text for r in kept[3]}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == ids[3]
    for r in got:
        ids_ = t.encode(last[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids_) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest()


def test_secrets_are_masked(spark):
    rows = spark.createDataFrame([(1, 'x password = "k9Xf27Qz81Lm" y', "en", "a", 0), (2, "plain", "en", "b", 0), (3, None, None, None, None)], SCHEMA)
    out = {r.doc_id: r.text for r in P.secrets(spark, rows, "").collect()}
    assert "k9Xf27" not in out[1] and out[1].startswith("x ") and out[2] == "plain" and out[3] is None


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, k):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.STAGES[k][1](spark, empty, "").count() == 0


def test_near_copies_of_eighty_percent(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    bases = [[word() for _ in range(120)] for _ in range(24)]
    texts = {d: w for d, w in enumerate(bases)}
    for d, w in enumerate(bases):
        more = [word() for _ in range((10, 15, 20, 24, 28, 32, 40, 60)[d % 8])]  # 5-word similarities from 0.92 to 0.66
        texts[100 + d] = w + more
        changed = list(w)
        for i in range(20, 120, (30, 45, 60)[d % 3]):
            changed[i] = word()
        texts[200 + d] = changed

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {d: shingles(w) for d, w in texts.items()}
    parent = {d: d for d in texts}

    def root(d):
        return d if parent[d] == d else root(parent[d])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    rows = spark.createDataFrame([(d, " ".join(w), "en", "s", 1) for d, w in texts.items()], SCHEMA).repartition(4)
    kept = sorted(r.doc_id for r in P.near_duplicates(spark, rows, "").collect())
    assert kept == [d for d in sorted(texts) if root(d) == d]
    near = [len(sets[d] & sets[e]) / len(sets[d] | sets[e]) for d in range(24) for e in (100 + d, 200 + d)]
    assert sum(0.8 <= s < 0.9 for s in near) > 10 and sum(s < 0.8 for s in near) > 10


def test_rows_without_or_with_one_id(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(90))
    clean = [text() for _ in range(80)]
    rows = [(d, t, "en", "s", 0) for d, t in enumerate(clean)]
    secret = 'x password = "k9Xf27Qz81Lm" y '
    rows += [(None, "short text", "en", "s", 1), (None, secret + clean[0], "en", "s", 2), (None, None, None, None, 3)]
    rows += [(200, "short text", "en", "s", 4), (200, clean[1] + " more words", "en", "s", 5), (201, text(), "en", "s", 6), (201, text(), "en", "s", 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    good = P.quality(spark, df, "")
    assert sorted((r.n_chars for r in good.collect() if r.n_chars)) == [2, 5, 6, 7]  # the clean row of an id outlives the short one
    kept = P.near_duplicates(spark, good, "").collect()
    assert sorted(r.n_chars for r in kept if r.n_chars) == [2, 6, 7]  # two texts of one id that are no copies both stay
    masked = {r.n_chars: r.text for r in P.secrets(spark, df, "").collect()}
    assert "k9Xf27" not in masked[2] and masked[2].endswith(clean[0])
    assert masked[1] == "short text" and masked[3] is None


def test_stage_folders_are_removed(spark, tmp_path):
    import os

    from corpusloom.llm.common import shared_folder

    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    top = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(top))
    assert P.run(spark, str(tmp_path)).count() > 0
    (new,) = [x for x in set(os.listdir(top)) - before if x.startswith("pipeline-")]
    assert [x for x in os.listdir(f"{top}/{new}") if not x.startswith(".")] == ["4"]


def test_texts_that_share_an_id_are_judged_apart(spark):
    rng = random.Random(31)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(90))
    x, y, a, b, long = text(), text(), text(), text(), " ".join([text() for _ in range(900)])
    rows = [(1, x), (2, x + " more"), (2, y), (3, y + " more"), (201, a), (201, b), (201, a), (201, a + " end"), (None, a), (300, long), (301, long + " more"), (302, "one"), (302, None)]
    df = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    kept = P.near_duplicates(spark, df, "").collect()
    least = min((a, a + " end"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, x), (2, y), (201, least), (201, b), (None, a), (300, long), (302, "one"), (302, None)], key=str)
