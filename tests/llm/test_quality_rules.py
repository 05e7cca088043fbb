import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm.quality_rules import concentrate, distances, quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words int, v int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9)))
    rows = []
    for d in range(300):
        text = ".\n".join(" ".join(word() for _ in range(rng.randint(5, 30))).capitalize() for _ in range(rng.randint(1, 12)))
        rows.append((d, text, "en" if d % 3 else "fr", f"s{d % 2}"))
    rows += [(1000 + i, " ".join(word() + "***" for _ in range(90)), "en", "s1") for i in range(4)]
    rows += [(2000 + i, " ".join(word().upper() + "!!" for _ in range(90)), "fr", "s0") for i in range(4)]
    rows += [(3000, None, None, None), (3001, "", "en", "s0"), (3002, " \n\t", "en", "s0"), (3003, "a b c " * 60, "en", "s0"), (3004, "x" * 100_000, "en", "s0"), (5, rows[5][1], "en", "s1"), (None, rows[6][1], None, "s1")]
    rows += [(3005, "one line\n" * 60 + " ".join(word() for _ in range(400)), "en", "s1"), (3006, "\xa0\n\xa0\n" + " ".join(word() for _ in range(60)), "en", "s1")]
    return rows


def test_counts_and_outliers(spark):
    rows = corpus()
    got = quality_rules(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, text, *_ in rows:
        r = by[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), d
        assert not (r.base_failed and r.kept)
    assert all(by[d].kept for d in range(300) if not by[d].base_failed)
    assert not any(by[d].kept for d in (*range(1000, 1004), *range(2000, 2004)))
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_blocks_agree(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in corpus()], SCHEMA).repartition(3)
    a = {r.doc_id: r.kept for r in quality_rules(df).collect()}
    b = {r.doc_id: r.kept for r in quality_rules(df, block_rows=60, broadcast_groups=0).collect()}
    assert a == b


def test_concentration_ignores_a_cluster():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (800, 6)), rng.normal(9, 0.5, (160, 6))])
    centre, scatter = concentrate(x, 0.75)
    assert np.abs(centre).max() < 0.3 and distances(x, centre, scatter)[800:].min() > 50


def test_rows_of_a_tiny_language_are_judged_by_all_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(d, " ".join(word() for _ in range(100)), "en", "s") for d in range(200)]
    rows += [(900 + d, " ".join(word() for _ in range(100)), "xx", "t") for d in range(4)]
    rows += [(950, " ".join(word().upper() + "#$%&|" for _ in range(100)), "xx", "t"), (951, "short", "yy", None)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[900 + d].kept and got[900 + d].distance < 25 for d in range(4)) and not got[950].kept and got[950].distance > 25
    assert not got[951].kept and got[951].base_failed


def test_blocks_of_a_large_group_agree_with_one_block(spark):
    rng = np.random.default_rng(6)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 400)]
    rows = []
    for d in range(3000):
        text = " ".join(words[i] for i in rng.integers(0, 400, 80))
        rows.append((d, text.upper() if d % 15 == 0 else text, "en", "s"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    a, b = ({r.doc_id: r.kept for r in quality_rules(df, block_rows=n).collect()} for n in (250, 10_000))
    assert a == b and all(a[d] == (d % 15 > 0) for d in a)
