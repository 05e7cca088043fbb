import random
import zlib

import pytest

from corpusloom.llm.toxicity import Channel, cores, disguised, restore, restored, score_toxicity, tokens

DOCS = "doc_id bigint, text string, label int, score double"
LABELS = "doc_id bigint, toxic int, text string"
BAD = ["wretch", "numbskull", "dolt"]


def corpus(n=600):
    rng = random.Random(6)
    words = ["the", "river", "stone", "under", "window", "letter", "morning", "garden", "silver", "people"]
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        toxic = d % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((d, " ".join(w), 1, 0.5))
        labels.append((d, int(toxic), "clash"))
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus()
    more = [(9000, None), (9001, ""), (9002, "you wr3tch"), (9003, "w r e t c h go"), (9004, "nuuumbskull"), (9005, "d.o.l.t"), (9006, "garden stone"), (9007, "river " * 30_000 + "dolt"), (5, docs[5][1]), (None, "the river")]
    df = spark.createDataFrame(docs + [(i, t, None, None) for i, t in more], DOCS).repartition(3)
    out = score_toxicity(df, spark.createDataFrame(labels + [(None, 1, None), (3, None, None), (4, 7, None)], LABELS)).collect()
    assert len(out) == len(docs) + len(more)
    by = {r.doc_id: r for r in out}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in range(600))
    held = [d for d in range(600) if by[d].held_out]
    assert sum(by[d].predicted == (d % 4 == 0) for d in held) >= 0.97 * len(held)
    assert [by[d].predicted for d in range(9000, 9008)] == [0, 0, 1, 1, 1, 1, 0, 1]


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, DOCS)
    turned = [(d, 1 - y, t) if zlib.crc32(str(d).encode()) % 4 == 2 else (d, y, t) for d, y, t in labels]
    a, b = ({r.doc_id: r.score for r in score_toxicity(df, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(20)
    assert {r.score for r in score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).collect()} == {0.0}
    assert score_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_channel():
    grams = {}
    for w in BAD * 5 + ["river", "stone"]:
        for i in range(len(w) + 1):
            g = f"  {w} "[i : i + 3]
            grams[g] = grams.get(g, 0) + 1
    c = Channel(grams)
    assert c.decode("d0lt") == "dolt" and c.decode("wr.e-t.c.h") == "wretch" and c.decode("doooolt") == "dolt"
    assert not disguised("river") and disguised("r1ver") and not disguised("123")
    assert restore("river,", c) == ["river"]


def test_decodings_equal_those_under_all_trigrams(spark):
    docs, _ = corpus(80)
    more = [(1000 + i, t, None, None) for i, t in enumerate(["xylophone Глупец", "xylophone, xylophone", "xylophone 漢字漢", "nooope stone", "xy1oph0ne гл.у-пец w0rd! r-i-v-e-r s t o n e", "wr3tch!! " * 3, None, ""])]
    df = spark.createDataFrame(docs + more, DOCS).repartition(3)
    got = {r.core: r.word for r in restored(df, "text").collect()}
    assert got["xy1oph0ne"] == "xylophone" and got["гл.у-пец"] == "глупец"
    grams = {}
    for _, text, _, _ in docs + more:
        for w in {w for t in tokens(text) for w in restore(t, None)}:
            if not any(a == b == c for a, b, c in zip(w, w[1:], w[2:], strict=False)):
                for i in range(len(w) + 1):
                    g = f"  {w} "[i : i + 3]
                    grams[g] = grams.get(g, 0) + 1
    all_ = Channel(grams)
    assert set(got) == {c for _, text, _, _ in docs + more for t in tokens(text) for c in cores(t)} and len(got) > 5
    assert got == {c: all_.decode(c) for c in got}


def test_marks_behind_words_and_digests_open_no_lattice():
    assert cores("lyreon$$$") == cores("tepf.###") == cores("0123456789abcdef01") == cores("river!!!") == cores("plain,") == []
    assert cores("a$$") == ["a$$"] and cores("d0lt!!") == ["d0lt", "d0lt!!"] and cores("d0lt***") == ["d0lt"]


_LEET = str.maketrans("oaeils", "04311$")
KINDS = {
    "leet": lambda w: w.translate(_LEET),
    "dotted": lambda w: ".".join(w),
    "spaced": lambda w: " ".join(w.translate(_LEET)),
    "repeated": lambda w: w[:2] + w[2] * 4 + w[3:],
}


@pytest.mark.parametrize("kind", list(KINDS))
def test_the_channel_finds_planted_disguise(spark, kind):
    """Held-out texts whose bad word stands in disguise only: found by the channel, not without it."""
    docs, labels = corpus(600)
    hidden = [(20_000 + i, f"the river {KINDS[kind](BAD[i % 3])} under stone", 1, 0.0) for i in range(60)]
    fair = [(30_000 + i, f"the river {KINDS[kind]('garden')} under stone", 1, 0.0) for i in range(60)]
    df, marked = spark.createDataFrame(docs + hidden + fair, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    on, off = ({r.doc_id: r.predicted for r in score_toxicity(df, marked, channel=c).collect()} for c in (True, False))
    found = lambda by, rows: sum(by[d] for d, *_ in rows) / len(rows)
    assert found(on, hidden) >= 0.95 and found(off, hidden) <= 0.4 and found(on, fair) <= 0.05  # a beginning may stand plainly, as in numb$ku11
    assert all(on[d] == off[d] for d, *_ in docs)


def test_an_id_labelled_both_ways_counts_as_toxic(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame(docs, DOCS)
    both = labels + [(d, 1 - y, *rest) for d, y, *rest in labels if y]
    a, b = ({r.doc_id: r.score for r in score_toxicity(df, spark.createDataFrame(x, LABELS).repartition(n)).collect()} for x, n in ((labels, 1), (both, 3)))
    assert a == b
