import random

import numpy as np

from corpusloom.llm.cotraining import CoTraining, classify_quality

DOCS = "doc_id bigint, text string, lang string, source string, score double, keep string"
LABELS = "doc_id bigint, quality int, text string"


def corpus(n=400):
    rng = random.Random(9)
    docs, labels = [], []
    for d in range(n):
        good = d % 3 > 0
        w = [rng.choice("alpha beta gamma delta river stone".split()) for _ in range(rng.randint(30, 80))]
        text = " ".join(w) if good else " ".join(x.upper() + "###" for x in w)
        docs.append((d, text, "en", f"{'good' if good or rng.random() < 0.2 else 'bad'}{d % 2}", 0.1, "x"))
        if d % 2 == 0:
            labels.append((d, int(good), "clash"))
    return docs, labels


def test_unlabelled_rows(spark):
    docs, labels = corpus()
    more = [(9000, None, None, None, None, None), (9001, "", "en", "good0", None, None), (9002, "river " * 30_000, "en", "good0", None, None), (None, "x y", None, None, None, None), docs[5]]
    out = classify_quality(spark.createDataFrame(docs + more, DOCS).repartition(3), spark.createDataFrame(labels + [(None, 1, None), (1, None, None)], LABELS)).collect()
    assert len(out) == len(docs) + len(more)
    by = {r.doc_id: r for r in out}
    unseen = [d for d in range(400) if d % 2]
    assert sum(by[d].keep == (d % 3 > 0) for d in unseen) >= 0.97 * len(unseen)
    assert all(0 <= x <= 1 for r in out for x in (r.score, r.text_score, r.meta_score))


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600)
    views = [np.column_stack([y * 2.0 - 1 + rng.normal(0, 0.7, 600), rng.normal(size=(600, 3))]) for _ in range(2)]
    known = np.where(np.arange(600) < 60, y, -1)
    held = np.arange(600) % 4 == 1
    m = CoTraining().fit(views, known, held, rounds=4, share=0.1, sure=0.8)
    assert len(m.exchanged) == 4 and all(min(x) > 0 for x in m.exchanged[:1])
    assert ((m.score(views)[1] > 0.5) == y)[60:].mean() > 0.93


def test_the_exchange_teaches_what_labelled_rows_lack():
    """Labelled rows show old words alone. Other rows have new ones, which only their metadata explain; the last have new words and no metadata."""
    found = {0: [], 4: []}
    for seed in range(3):
        rng = np.random.default_rng(seed)
        n = 1500
        y = rng.integers(0, 2, n)
        known = np.where(np.arange(n) < 100, y, -1)
        last = np.arange(n) >= 1200
        words = rng.normal(0, 0.3, (n, 6))
        words[np.arange(n), np.where(known >= 0, 0, 2) + y] += 2.0
        meta = np.where(last, 0.0, y * 2.0 - 1)[:, None] + rng.normal(0, 0.4, (n, 2)) * ~last[:, None]
        for rounds, right in found.items():
            m = CoTraining().fit([words, meta], known, np.arange(n) % 4 == 1, rounds=rounds, share=0.2, sure=0.9)
            (by_words, _), _ = m.score([words, meta])
            right.append(((by_words > 0.5) == y)[last].mean())
    assert max(found[0]) < 0.6 and min(found[4]) > 0.8


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(12)
    assert {r.score for r in classify_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert classify_quality(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_all_unlabelled_rows_are_the_pool(spark, monkeypatch):
    docs, labels = corpus(300)
    more = [(10_000 + i, f"{d[1]} {i}", "xx", f"rare{i % 3}", 0.1, "x") for i, d in enumerate(docs * 25)]
    seen, fit = [], CoTraining.fit

    def watched(self, views, y, held, rounds, share, sure, over):
        seen.append(int(over(lambda v, u: [np.array([len(u)], float)])[0][0]))
        return fit(self, views, y, held, rounds, share, sure, over)

    monkeypatch.setattr(CoTraining, "fit", watched)
    out = classify_quality(spark.createDataFrame(docs + more, DOCS).repartition(3), spark.createDataFrame(labels, LABELS), rounds=1)
    assert out.count() == len(docs) + len(more) and seen == [len(docs) + len(more) - len(labels)]


def test_sums_over_blocks_teach_as_one_table_does():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 900)
    views = [np.column_stack([y * 2.0 - 1 + rng.normal(0, 0.7, 900), rng.normal(size=(900, 3))]) for _ in range(2)]
    known, held = np.where(np.arange(900) < 90, y, -1), np.arange(900) % 4 == 1
    own, point = [x[90:] for x in views], np.random.default_rng(0).random(810)

    def over(f):
        parts = [f([x[a : a + 100] for x in own], point[a : a + 100]) for a in range(0, 810, 100)]
        return [sum(p) for p in zip(*parts, strict=True)]

    one = CoTraining().fit(views, known, held, rounds=3, share=0.1, sure=0.8)
    two = CoTraining().fit([x[:90] for x in views], known[:90], held[:90], rounds=3, share=0.1, sure=0.8, over=over)
    assert one.exchanged == two.exchanged and all(np.allclose(a, b) for a, b in zip(one.views, two.views, strict=True))


def test_held_out_rows_and_labels_both_ways(spark):
    """Both views carry signal, and an id with both labels counts as 0, on any partitioning."""
    rng = random.Random(4)
    docs, labels = [], []
    for d in range(600):
        good = rng.random() < 0.5
        words = [rng.choice(["river", "stone", "cloud", "field"] if good != (rng.random() < 0.2) else ["buy", "cheap", "click", "now"]) for _ in range(60)]
        text = (" " if good != (rng.random() < 0.1) else "\n").join(words)
        docs.append((d, text, "en", "s", 0.0, ""))
        labels.append((d, int(good), ""))
    learn = [x for x in labels if x[0] % 4]
    df = spark.createDataFrame(docs, DOCS)
    out = classify_quality(df.repartition(3), spark.createDataFrame(learn, LABELS)).collect()
    held = {d: y for d, y, _ in labels if d % 4 == 0}

    def right(column):
        return sum((r[column] >= 0.5) == held[r.doc_id] for r in out if r.doc_id in held) / len(held)

    assert right("text_score") > 0.85 and right("meta_score") > 0.8 and right("score") >= 0.9
    both = learn + [(d, 1, "") for d, y, _ in learn if not y][:50]
    again = classify_quality(df.repartition(5), spark.createDataFrame(both, LABELS).repartition(3)).collect()
    near = {r.doc_id: r.score for r in out}
    assert max(abs(r.score - near[r.doc_id]) for r in again) < 1e-6
