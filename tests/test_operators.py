"""Quirks that the synthetic tables do not show, and properties."""

import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import codec, text
from corpusloom.operators import budget, dedup, grounding, reports, retrieval, scan, trace, training
from corpusloom.plans import corpus


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_budget_keeps_the_crossing_row(spark):
    for sizes, target, want in (([4, 4, 4], 5, 2), ([5, 5], 5, 1), ([9, 1], 5, 1), ([], 5, 0)):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, n long")
        assert budget.budget_prefix(df, F.col("n"), target, "id", budget.range_bucket(df, "id")).count() == want


def test_running_sums_do_not_depend_on_buckets_or_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, n long")
    want, sums = {}, {}
    for i, g, n in rows:
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + n
    for buckets, parts in ((1, 1), (7, 5), (64, 3)):
        got = budget.running_before(df.repartition(parts), F.col("n"), "id", budget.range_bucket(df, "id", buckets, per_bucket=1), ["g"])
        assert {r.id: r.before for r in got.collect()} == want


def test_shards(spark):
    for n, want in ((0, []), (1, [1]), (3, [1, 1, 1]), (4, [1, 1, 1, 2])):
        df = spark.range(n)
        assert [r.shard for r in budget.assign_shards(df, "id", budget.range_bucket(df, "id"), 3).orderBy("id").collect()] == want


def test_paragraphs(spark):
    long = "shared paragraph " * 6
    exact79, exact80 = "a" * 79, "b" * 80
    rows = [
        ("wiki", 0, 1, f"{long}\n\nown one " + "x" * 200), ("wiki", 0, 2, f"{long.upper()}  \n\nown two " + "y" * 200), ("wiki", 0, 3, f"{long}\n\nshort"),
        ("wiki", 0, 4, f"{exact79}\n\n{exact80}\n\n" + "z" * 150), ("wiki", 0, 5, f"{exact79}\n\n{exact80}\n\n" + "w" * 150),
        ("kod", 2, 6, f"{long}\n\n" + "c" * 200), ("kod", 2, 7, f"{long}\n\n" + "c" * 200), ("kod", 2, 8, f"{long}\n\n" + "d" * 200),
    ]
    df = spark.createDataFrame(rows, "grp string, grp_rank int, id int, text string").repartition(3)
    more = dict(id_col="id", text_col="text", order=["grp_rank", "id"], group_col="grp", whole_doc_groups=["kod"])
    got = {r.id: r.text for r in dedup.dedup_paragraphs(df, **more).collect()}
    assert set(got) == {1, 2, 4, 5, 6, 8}
    assert got[2].startswith("own two") and exact79 in got[5] and exact80 not in got[5] and got[8].startswith("shared")
    again = dedup.dedup_paragraphs(df.drop("text").join(spark.createDataFrame(list(got.items()), "id int, text string"), "id"), **more)
    assert {r.id: r.text for r in again.collect()} == got


def test_a_row_beyond_its_cap_does_not_keep_its_copy_out(spark):
    rows = [("a", 1, 30, "p1"), ("a", 2, 20, "p2"), ("a", 3, 10, "p3"), ("b", 4, 10, "p3"), ("b", 5, 9, "p1")]
    df = spark.createDataFrame(rows, "source string, id int, size int, text string")
    got = dedup.capped_unique(df, {"a": 2, "b": 5}, source_col="source", id_col="id", text_col="text", size_col="size")
    assert sorted(r.id for r in got.collect()) == [1, 2, 4]


@pytest.mark.parametrize("parts,want", [
    ([100, 50], []), ([150, 100], [252]), ([1399 - 700, 700], [1401]), ([700, 700], [700, 700]), ([2000], [2000]), ([100, 1500], [1500]), ([0, 0], []),
])
def test_chunks(spark, parts, want):
    got = one(spark, "\n\n".join("x" * n for n in parts), retrieval.pack_chunks)
    assert [len(c) for c in got] == want


def test_paths(spark):
    f = lambda p, v: one(spark, p, lambda c: text.is_translation(c, v))
    assert f("docs/fr/x.md", "v1") and f("README.tr-TR.md", "v1") and f("pt-br/x", "v1") and not f("src/go/x.md", "v1") and not f("framework/x", "v1") and f("a/cs/x", "v1")
    assert f("docs/fr/x.md", "v2") and not f("docs/en/fr/x.md", "v2")
    assert f("README.japanese.md", "v3") and not f("en-us/french.md", "v3") and not f("framework/x", "v3")
    assert one(spark, "root/a/b/c/D e.md", text.path_slug) == "b-c-d-e" and one(spark, "root/.md", text.path_slug) == "doc"
    assert one(spark, "x/CVE-2020-1234_y", text.cve_id) == "CVE-2020-1234" and one(spark, "plain", text.cve_id) == "plain"


def test_nul_and_notes(spark):
    df = spark.createDataFrame([(b"ab\x00c",), (b"abc",), (b"x" * 5000 + b"\x00",)], "c binary")
    assert [r[0] for r in df.select(text.has_nul(F.col("c"))).collect()] == [True, False, False]
    assert one(spark, "x" * 1810, text.truncate_note).endswith("[10 karakter kesildi]") and one(spark, "x", text.truncate_note) == "x"


def test_json_in_prose():
    assert codec.scan_json('say {bad} then {"a": "}{\\" ", "b": {"c": 1}} end') == '{"a": "}{\\" ", "b": {"c": 1}}'
    assert codec.scan_json("none") is None and codec.scan_json(None) is None and codec.scan_json('{"open": 1') is None


def test_signature_ignores_order(spark):
    df = spark.createDataFrame([("t", {"a": "1", "b": "2"}), ("t", {"b": "2", "a": "1"})], "tool string, p map<string,string>")
    assert df.select(codec.call_signature(F.col("tool"), F.col("p"))).distinct().count() == 1


def history(lengths, budget=14_000, keep=5):
    kept = list(range(len(lengths)))
    while sum(lengths[i] for i in kept) > budget and len(kept) > keep:
        del kept[2:4]
    return kept


def test_history_against_the_loop(spark):
    rng = random.Random(4)
    cases = [[2000] * 7, [2800] * 5, [4000] * 5, [14_000], [9000, 9000, 1, 1, 1, 1], *([rng.randint(1, 4000) for _ in range(rng.randint(1, 14))] for _ in range(25))]
    rows = [(c, t, "user", "x" * n) for c, lengths in enumerate(cases) for t, n in enumerate(lengths)]
    got = {}
    for r in trace.trim_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)).collect():
        got.setdefault(r.conv_id, []).append(r.turn)
    assert {c: sorted(t) for c, t in got.items()} == {c: history(x) for c, x in enumerate(cases)}


def test_loop_guard(spark):
    def actions(calls):
        df = spark.createDataFrame([(0, i, c) for i, c in enumerate(calls)], "s int, i int, tool string")
        return [r.action for r in trace.loop_guard(df, session="s", order=["i"], tool="tool", signature=F.col("tool")).orderBy("i").collect()]

    assert actions("AAA") == ["run", "warn", "force"]
    assert actions("ABA") == ["run"] * 3
    assert actions("ABABA")[-1] == "force"
    assert actions("ABCDEFG")[-1] == "force" and actions("ABCDEF")[-1] == "run"


def test_minmax_of_equal_scores_and_blend(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 0.5, 3.0)], "id int, sem double, lex double")
    got = {r.id: r.hybrid for r in retrieval.hybrid(df, "sem", "lex").collect()}
    assert got == {1: 0.0, 2: 0.32}
    assert [r.id for r in retrieval.search(df.fillna(0.0), semantic=None, lexical="lex", id_col="id", k=1).collect()] == [2]


def test_masking_happens_before_cutting(spark):
    secret = "p" * 20
    line = "x" * 70 + f" password = '{secret}'"
    assert "ppp" not in one(spark, line, scan.mask_secrets)
    assert one(spark, "a", lambda c: scan.first_family(c)) is None


def test_grep_falls_back_to_text(spark):
    lines = spark.createDataFrame([(1, "a (b"), (2, "ab")], "n int, line string")
    assert [r.n for r in scan.grep(lines, "(B", ["n"]).collect()] == [1]


def test_gap_items_and_pending(spark):
    schema = "result struct<sonuclar:array<struct<alan:string,domain:string,bosluklar:array<struct<konu:string,neden:string,oncelik:string>>>>>, sonuclar array<struct<alan:string,domain:string,bosluklar:array<struct<konu:string,neden:string,oncelik:string>>>>"
    item = [("al", "d1", [("k", "n", "yuksek"), ("k2", "n", None)])]
    df = spark.createDataFrame([((item,), None), (None, item)], schema)
    assert sorted(r.priority for r in reports.gap_items(df).collect()) == ["orta", "orta", "yuksek", "yuksek"]
    a, done = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, "x" * 3000), (2, "x")], "id int, out string")
    assert sorted(r.id for r in grounding.pending(a, done, "id", "out").collect()) == [2, 3]


def test_token_arrays(spark):
    df = spark.createDataFrame([(1, list(range(40))), (2, [1])], "id int, ids array<int>")
    w = training.token_windows(df, "id", "ids", 8, 5).collect()
    assert len(w) == 5 and all(r.id == 1 and r.y == [t + 1 for t in r.x] for r in w)
    assert df.select(training.last_tokens(F.col("ids"), 3).alias("t")).first().t == [37, 38, 39]
    enc = pytest.importorskip("public_tokenizers")
    got = training.encode(spark.createDataFrame([("hello world",), (None,)], "t string"), "t", enc.path("byte_bpe_50k.json")).collect()
    assert [len(r.ids) for r in got] == [2, 0]


def test_embedding_by_any_model(spark):
    df = retrieval.embed(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda texts: [[float(len(t))] for t in texts])
    assert [r.embedding[0] for r in df.collect()] == [11.0, 9.0]


def test_capped_unique_plans_do_not_grow(spark):
    rows = [(i, f"s{i % 19}", f"t{i % 200}", i) for i in range(1900)]
    df = spark.createDataFrame(rows, "id int, source string, text string, size int")
    caps = {f"s{k}": 5 for k in range(19)}
    got = dedup.capped_unique(df, caps, source_col="source", id_col="id", text_col="text", size_col="size")
    seen, want = set(), set()
    for s, cap in caps.items():
        best = {}
        for r in sorted((r for r in rows if r[1] == s and r[2] not in seen), key=lambda r: (-r[3], r[0])):
            best.setdefault(r[2], r)
        for r in sorted(best.values(), key=lambda r: (-r[3], r[0]))[:cap]:
            seen.add(r[2])
            want.add(r[0])
    assert {r.id for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") < 5


def test_ids_chosen_before_get_a_number(spark):
    df = spark.createDataFrame([("x", "a", "one", 9), ("x", "b", "two", 8), ("y", "b", "three", 9), ("z", "b", "four", 7)], "id string, source string, text string, size int")
    known = spark.createDataFrame([("z",)], "id string")
    got = dedup.capped_unique(df, {"a": 2, "b": 3}, source_col="source", id_col="id", text_col="text", size_col="size", known=known)
    assert {(r.id, r.text) for r in got.collect()} == {("x", "one"), ("x-1", "two"), ("y", "three"), ("z-2", "four")}


def test_paragraphs_of_rows_that_share_an_id(spark):
    p, q, x = ("shared words " * 9).strip(), "only in the first " * 14, "only in the second " * 14
    rows = [("wiki", 0, 1, f"{p}\n\n{q}"), ("tr-teknik", 1, 1, f"{x}\n\n{p}"), ("wiki", 0, None, f"{p}\n\n{q}more {q}"), ("wiki", 0, None, f"{p}\n\n{x}more {x}"), ("kod", 2, 1, f"{p}\n\n{q}")]
    df = spark.createDataFrame(rows, "grp string, grp_rank int, doc_id int, text string").repartition(3)

    def brute(rows):
        seen, out = set(), []
        for g, _, i, t in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
            kept = [part for part in t.split("\n\n") if len(part.strip()) < 80 or not (part.strip().lower() in seen or seen.add(part.strip().lower()))]
            text = "\n\n".join(kept).strip()
            if len(text) >= 200:
                out.append((i, text))
        return out

    got = dedup.dedup_paragraphs(df.where("grp <> 'kod'"), id_col="doc_id", text_col="text", order=["grp_rank", "doc_id"])
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    ids = [i for i, _ in found]
    assert ids.count(1) == 2 and ids.count(None) == 2 and any(t.startswith(q.strip()[:20]) for _, t in found if t) and any(t.startswith(x.strip()[:20]) for _, t in found)
    assert sum(t.count(p) for _, t in found) == 1 == sum(t.count(p) for _, t in brute([r for r in rows if r[0] != "kod"]))
    built = corpus.build_corpus(df.select("grp", "doc_id", "text"), {"wiki": 10**9, "tr-teknik": 10**9, "kod": 10**9}).collect()
    assert len(built) == 5 and {r.split for r in built} <= {"train", "val"}
    cut = corpus.build_corpus(df.select("grp", "doc_id", "text"), {"wiki": 10, "tr-teknik": 10**9}).collect()
    assert len(cut) == 2  # the wiki row that crosses the budget, and the other group's row of the same id


def test_paragraphs_against_brute_force(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta"]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(40)]
    rows = [(rng.randrange(3), rng.choice([None, *range(12)]), "\n\n".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))) for _ in range(60)]
    rows = list({r[:2]: r for r in rows}.values())
    seen, want = set(), []
    for _, i, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        kept = [p for p in t.split("\n\n") if len(p) < 80 or not (p in seen or seen.add(p))]
        if len("\n\n".join(kept).strip()) >= 200:
            want.append((i, "\n\n".join(kept).strip()))
    got = dedup.dedup_paragraphs(spark.createDataFrame(rows, "g int, id int, text string").repartition(4), id_col="id", text_col="text", order=["g", "id"])
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)


def test_chosen_rows_without_a_size_and_ties(spark):
    rows = [("a", 1, None, "p"), ("a", 2, None, "q"), ("a", 3, 5, "r"), ("a", 4, 5, "r"), ("b", 9, 7, "s" * 1000 + "x"), ("b", 9, 7, "s" * 1000 + "y"), ("b", 8, None, None), ("b", 7, None, None)]
    df = spark.createDataFrame(rows, "source string, id int, size int, text string").repartition(3)
    got = dedup.capped_unique(df, {"a": 2, "b": 3}, source_col="source", id_col="id", text_col="text", size_col="size").collect()
    assert sorted((r.id, r.size) for r in got) == [(1, None), (3, 5), (7, None), (9, 7)] or sorted(((r.id, r.size) for r in got), key=str) == sorted([(1, None), (3, 5), (7, None), (9, 7)], key=str)
    first = min(rows[4:6], key=lambda r: hashlib.md5(r[3].encode()).hexdigest())
    assert [r.text for r in got if r.id == 9] == [first[3]]


def test_large_dictionaries(spark):
    rng = random.Random(5)
    letters = "abcdefg"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))
    table = {word(): word()[::-1] + "ş" for _ in range(400)}
    cased = lambda w: rng.choice([w, w.upper(), w.capitalize()])
    texts = ["".join(cased(word()) + rng.choice([" ", ", ", "-", "\n", "1"]) for _ in range(30)) for _ in range(40)] + ["", None, "...", "ABC abc Abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    keep = sorted(table)[:20]
    want = {r.id: r.t for r in df.withColumn("t", text.dict_correct(F.col("t"), table, keep)).collect()}
    entries = spark.createDataFrame([*table.items(), ("abc", None), (None, "x")], "word string, to string")
    got = text.correct_words(df, "t", entries, spark.createDataFrame([(k,) for k in keep], "word string"))
    assert {r.id: r.t for r in got.collect()} == want
    missing = lambda d: {(r.word, r.n) for r in text.dict_missing(df, ["t"], d, keep).collect()}
    assert missing(entries.where("to IS NOT NULL")) == missing(table)


def test_averages_of_long_series(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.random()) for g, n in (("a", 1), ("b", 2), ("c", 5000)) for i in range(n)]
    want = {}
    for g, _, v in rows:
        want[g] = v if g not in want else 0.9 * want[g] + 0.1 * v
    got = {r.g: r.ema for r in reports.ema(spark.createDataFrame(rows, "g string, i int, v double").repartition(3), "v", "i", 0.1, ["g"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)
    whole = reports.ema(spark.createDataFrame(rows[3:], "g string, i int, v double"), "v", "i").first().ema
    assert abs(whole - want["c"]) < 1e-12


def test_json_scan_equals_a_parser_at_every_brace():
    decoder = json.JSONDecoder()

    def plain(t):
        for brace in re.finditer(r"\{", t):
            try:
                _, end = decoder.raw_decode(t, brace.start())
            except ValueError:
                continue
            return t[brace.start() : end]
        return None

    rng = random.Random(1)
    pieces = ["{", "}", "[", "]", '"', ":", ",", " ", "a", "1", "\\", '"a":', '{"b":1}', "null", "\n", "-", "0.5", "\\u12ab", '\\"', "NaN"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 18)))
        assert codec.scan_json(t) == plain(t), t


@pytest.mark.parametrize("t", ["{" * 1_000_000, '{"a":' * 200_000, '{"a":[' * 160_000, '{"a":"{","b":' * 80_000])
def test_json_scan_is_linear(t):
    began = time.perf_counter()
    assert codec.scan_json(t) is None and time.perf_counter() - began < 5


def test_lines_and_lenient_bytes(spark):
    rng = random.Random(2)
    raw = [bytes(rng.choice([0x61, 0xC3, 0xA9, 0xFF, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0x0A]) for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["\ufffd \ue000 \ue001\ue002".encode(), b"\xef\xbf\xbd\xef\xbf"]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, c binary")
    assert {r.id: r.t for r in df.select("id", text.decode_leniently(F.col("c")).alias("t")).collect()} == {i: b.decode("utf-8", errors="ignore") for i, b in enumerate(raw)}
    texts = ["a\nb\n", "", "\n", "a\r\nb\rc", "x\x0by\x0cz\x85w\u2028v\n\n", "one"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", text.lines_of(F.col("t")).alias("l")).collect()
    assert {r.id: r.l for r in got} == {i: t.splitlines() for i, t in enumerate(texts)}


def test_grep_patterns_of_another_dialect(spark):
    lines = spark.createDataFrame([(1, "  ab BB  " + "x" * 300), (2, "(?P<x>b"), (3, "*+"), (4, "ŞEKER")], "n int, line string")
    found = lambda p: [r.n for r in scan.grep(lines, p, ["n"]).collect()]
    assert found(r"(?P<x>b)(?P=x)") == [1] and found("(?P<x>b") == [2] and found("*+") == [3] and found("şeker") == [4]
    cut = scan.grep(lines, "ab", ["n"]).first().line
    assert cut == ("ab BB  " + "x" * 300)[:160]
    assert {r.family: r.example for r in scan.log_triage(lines.select("n", F.concat(F.lit("   sudo "), "line").alias("line")), F.col("n")).collect()}["privilege"].startswith("sudo")


def test_stored_index(spark, tmp_path):
    rows = [(1, "red fox red"), (2, "blue fox"), (3, "green"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    index = retrieval.bm25_index(df, "id", "text")
    retrieval.write_index(index, f"{tmp_path}/index")
    stored = retrieval.read_index(spark, f"{tmp_path}/index")
    of = lambda d: {r.id: round(r.score, 9) for r in d.collect()}
    query = ["red", "fox", "fox", "none"]
    assert of(retrieval.bm25_scores(stored, query)) == of(retrieval.bm25_scores(index, query)) == of(retrieval.bm25_direct(df.where("text IS NOT NULL").unionByName(df.where("id = 4")), "id", "text", query))
    plan = retrieval.bm25_scores(stored, query)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan


def test_query_vectors_have_unit_length():
    assert retrieval.embed_query("abcd", lambda texts: [[3.0, 4.0] for _ in texts]) == [0.6, 0.8]
