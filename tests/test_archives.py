"""The archive source: splits, pushed filters and odd entries."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.corpus import build_chunks
from corpusloom.sources import archives
from corpusloom.sources.archives import Rules, members, read_archives


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """One archive of 400 files, stored, deflated, packed by bzip2 and by a method that is not read, and a corrupt one."""
    top = tmp_path_factory.mktemp("zips")
    rng = random.Random(4)
    with zipfile.ZipFile(top / "big.zip", "w") as z:
        for i in range(400):
            method = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2][i % 3] if i % 50 else zipfile.ZIP_LZMA
            z.writestr(f"root/d{i % 7}/f{i}.{['md', 'txt', 'png'][i % 3 if i % 5 else 0]}", bytes(rng.choice(b"ab \n\xff\xc3\xa9") for _ in range(rng.randint(50, 6000))), method)
        z.writestr("root/nul.md", b"x" * 300 + b"\0")
        z.mkdir("root/empty")
    (top / "bad.zip").write_bytes(b"PK no archive")
    return top


def wanted(top, rules):
    """What one pass through each archive gives, without entries packed by LZMA."""
    out = []
    for f in sorted(top.glob("*.zip")):
        rows = list(members(io.BytesIO(f.read_bytes()), f.name, rules))
        if f.name == "big.zip":
            odd = {x.filename.split("/", 1)[1] for x in zipfile.ZipFile(f).infolist() if x.compress_type == zipfile.ZIP_LZMA}
            rows = [r for r in rows if r[1] not in odd]
        out += rows
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_many_tasks_read_one_archive(spark, large):
    rules = Rules((".md", ".txt"), 120, 5000)
    df = read_archives(spark, str(large), extensions=rules.extensions, max_bytes=rules.high, run_bytes=30_000)
    assert df.rdd.getNumPartitions() > 5 and df.rdd.glom().map(len).filter(lambda n: n > 0).count() > 5
    assert rows(df) == wanted(large, rules)
    one = read_archives(spark, str(large / "big.zip"), extensions=rules.extensions, max_bytes=rules.high)
    assert rows(one) == [r for r in wanted(large, rules) if r[0] == "big.zip"]
    spark.dataSource.register(archives.ZipTextSource)
    source = spark.read.format("ziptext").option("extensions", ".md,.txt").option("maxbytes", 5000).option("runbytes", 30_000).load(str(large))
    assert source.rdd.getNumPartitions() > 5 and rows(source) == wanted(large, rules)


@pytest.mark.parametrize("condition", [
    "path = 'd1/f8.txt'", "path LIKE 'd3/%' AND size >= 1000", "archive = 'bad.zip'", "archive <> 'bad.zip' AND size > 4000", "NOT path LIKE 'd3/%'", "path IS NULL", "size = 700 OR size > 4900 OR path RLIKE 'f1.$'",
])
def test_conditions_on_the_directory(spark, large, condition):
    everything = spark.createDataFrame(wanted(large, Rules()), archives.SCHEMA)
    assert rows(read_archives(spark, str(large), run_bytes=50_000, where=condition)) == rows(everything.where(condition))


def test_conditions_are_tested_before_anything_is_read(spark, large):
    df = read_archives(spark, str(large), run_bytes=50_000)
    few = read_archives(spark, str(large), run_bytes=50_000, where=F.col("path").startswith("d3/") & (F.col("size") >= 1000))
    assert few.rdd.getNumPartitions() < df.rdd.getNumPartitions() / 2
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter") < plan.index("Relation" if "Relation" in plan else "zipdirectory")


def test_broken_entries_are_passed_over(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(3):
            z.writestr(f"r/{i}.md", f"text {i} " * 100)
    raw = bytearray(data.getvalue())
    at = zipfile.ZipFile(io.BytesIO(raw)).getinfo("r/1.md").header_offset
    raw[at + 40] ^= 0xFF
    (tmp_path / "x.zip").write_bytes(raw)
    assert [r.path for r in read_archives(spark, str(tmp_path)).orderBy("path").collect()] == ["0.md", "2.md"]
    assert read_archives(spark, str(tmp_path), extensions=(".none",)).count() == 0


def test_chunks_are_cleaned_by_kind(spark, tmp_path):
    body = "\n\n".join(f"see [the page {i}](http://x/y) and :func:`~open` <b>now</b> " + "word " * 60 for i in range(6))
    with zipfile.ZipFile(tmp_path / "org__repo.zip", "w") as z:
        z.writestr("root/a.md", body)
        z.writestr("root/b.rst", body + "\n\n.. note:: hidden\n")
    texts = archives.retrieval_texts(spark, str(tmp_path), (".md", ".rst"))
    chunks = build_chunks(texts, "source", "text", F.col("source"), kind_col="kind").collect()
    md, rst = ("".join(r.text for r in chunks if r.source == f"repo:{n}") for n in ("a.md", "b.rst"))
    assert "see the page 1 and :func:`~open` now" in md and "http" not in md
    assert "see [the page 1](http://x/y) and open <b>now</b>" in rst and "note::" not in rst
