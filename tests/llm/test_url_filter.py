import datetime as dt
import random

from pyspark.sql import functions as F

from corpusloom.llm.url_filter import domains, filter_urls, host

CAPTURES = "page_id bigint, url string, fetched date, host string, list string, salt int"
ENTRIES = "host string, list string, since date, blocks boolean, page_id string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def brute(captures, entries):
    state = {}
    for h, name, since, blocks, _ in entries:
        if None not in (h, name, since):
            by = state.setdefault((h, name), {})
            by[since] = by.get(since, False) or bool(blocks)
    out = []
    for page, hosts, when in captures:
        met = []
        for depth, h in enumerate(hosts):
            for (eh, name), by in state.items():
                before = [s for s in by if when is not None and s <= when]
                if eh == h and before and by[max(before)]:
                    met.append((depth, name, h))
        best = min(met, default=(None, None, None))
        out.append((page, len(met), not met, best[2], best[1]))
    return sorted(out, key=str)


def test_host_and_domains(spark):
    urls = ["HTTP://User:p@A.b.Example.com:80/x?y", "https://example.org.", "no url", None, "ftp://h/x", "https://a.b#f"]
    d = spark.createDataFrame([(u,) for u in urls], "u string").select(host(F.col("u")).alias("h"))
    assert [r.h for r in d.collect()] == ["a.b.example.com", "example.org", "", "", "h", "a.b"]
    assert d.select(domains(F.col("h")).alias("d")).first().d == ["a.b.example.com", "b.example.com", "example.com"]


def test_against_brute_force(spark):
    rng = random.Random(2)
    names = ["example.com", "a.example.com", "x.a.example.com", "other.org", "w.other.org"]
    entries = [(rng.choice(names), rng.choice(["bad", "worse"]), day(rng.randint(0, 40)), rng.random() < 0.6, "x") for _ in range(40)]
    entries += [entries[0], (None, "bad", day(1), True, "x"), ("other.org", None, day(1), True, "x"), ("other.org", "bad", None, True, "x"), ("example.com", "bad", day(9), None, "x")]
    up = lambda h: [".".join(h.split(".")[i:]) for i in range(len(h.split(".")) - 1)]
    given = []
    for i in range(300):
        h = rng.choice(names[:1] * 10 + names)
        given.append((i, f"https://{h}/p{i}", h, day(rng.randint(-3, 45))))
    rows = [(i, u, w, "c", "d", 3) for i, u, h, w in given] + [(900, None, day(5), "c", "d", 3), (901, "https://example.com/", None, "c", "d", 3), (902, "", day(5), None, None, None), (5, given[5][1], given[5][3], "c", "d", 3)]
    want = brute([(i, up(h), w) for i, u, h, w in given] + [(900, [], day(5)), (901, ["example.com"], None), (902, [], day(5)), (5, up(given[5][2]), given[5][3])], entries)
    c = spark.createDataFrame(rows, CAPTURES).repartition(3)
    got = filter_urls(c, spark.createDataFrame(entries, ENTRIES)).select("page_id", "n_active", "kept", "host_matched", "list_matched").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_empty(spark):
    c, e = spark.createDataFrame([(1, "https://a.b/", day(1), None, None, None)], CAPTURES), spark.createDataFrame([], ENTRIES)
    assert filter_urls(c, e).first().kept
    assert filter_urls(c.limit(0), e).count() == 0


def test_very_long_urls(spark):
    deep = ".".join(["a"] * 300) + ".example.com"
    rows = [(1, f"https://example.com/{'x' * 200_000}", day(3)), (2, f"https://{deep}/y", day(3)), (3, "https://" + "z" * 100_000, day(3))]
    c = spark.createDataFrame([(i, u, w, "c", "d", 3) for i, u, w in rows], CAPTURES)
    got = filter_urls(c, spark.createDataFrame([("example.com", "bad", day(1), True, "x")], ENTRIES)).collect()
    assert {(r.page_id, r.kept, r.host_matched) for r in got} == {(1, False, "example.com"), (2, False, "example.com"), (3, True, None)}
