import gzip
import io
import zipfile

from pyspark.sql import functions as F

from corpusloom.operators.scan import explode_lines
from corpusloom.sources import archives, records, sinks
from corpusloom.streaming import live


def archive(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)


def test_archives(spark, tmp_path):
    archive(tmp_path / "a.zip", {"root/x.md": "m" * 200, "root/node_modules/y.md": "n" * 200, "root/small.md": "s", "root/bin.md": b"\x00" * 200, "root/Z.MD": b"\xff" + b"z" * 200, "root/pic.png": "p" * 200})
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    df = archives.read_archives(spark, str(tmp_path), extensions=(".md",), deny=("node_modules/",))
    got = {(r.archive, r.path): r for r in df.collect()}
    assert set(got) == {("a.zip", "x.md"), ("a.zip", "Z.MD"), ("bad.zip", None)}
    assert got["a.zip", "Z.MD"].text == "z" * 200 and got["bad.zip", None].error
    assert sorted(r.source for r in archives.labelled(df).collect()) == ["a:Z.MD", "a:x.md"]
    spark.dataSource.register(archives.ZipTextSource)
    again = spark.read.format("ziptext").option("extensions", ".md").option("deny", "node_modules/").load(str(tmp_path))
    assert {(r.archive, r.path) for r in again.collect()} == set(got)


def test_jsonl(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"q": "x"}\n\nbroken\n{"q": "y"}\n')
    assert sorted(r.q for r in records.read_jsonl(spark, str(tmp_path), "q string").collect()) == ["x", "y"]
    assert records.read_jsonl(spark, str(tmp_path), "q string", keep_corrupt=True).where("_corrupt IS NOT NULL").count() == 1


def test_cwe(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<?xml version="1.0"?><Catalog><Weaknesses><Weakness ID="79" Name="XSS"><Description>One <b>two</b> ' + "three " * 50 + "</Description><Potential_Mitigations><M>first fix</M></Potential_Mitigations></Weakness>"
        '<Weakness ID="1" Name="short"><Description>tiny</Description></Weakness></Weaknesses></Catalog>'
    )
    got = records.render_cwe(spark, str(tmp_path / "c.xml")).collect()
    assert [r.id for r in got] == ["79"] and "One two three" in got[0].text and got[0].text.endswith("Mitigation: first fix")


def test_markdown_tree_and_lines(spark, tmp_path):
    (tmp_path / "sec").mkdir()
    (tmp_path / "sec" / "topic.md").write_text("# T\nbody")
    r = records.read_markdown_tree(spark, str(tmp_path)).first()
    assert (r.category, r.slug, r.text) == ("sec", "topic", "# T\nbody")
    assert [(x.line_no, x.line) for x in records.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, "# T"), (2, "body")]
    assert explode_lines(spark.createDataFrame([(1, "a\nb")], "id int, t string"), "id", "t").count() == 2


def test_parquet_text(spark, tmp_path):
    spark.createDataFrame([("  " + "x" * 300,), ("short",), (None,)], "text string").write.parquet(str(tmp_path / "p"))
    assert [len(r.text) for r in records.read_parquet_text(spark, str(tmp_path / "p")).collect()] == [300]


def test_sinks(spark, tmp_path):
    df = spark.range(45).select(F.concat(F.lit("d"), "id").alias("text"), (F.col("id") % 2).alias("tier")).coalesce(1)
    sinks.write_sharded(df, str(tmp_path / "s"), 20)
    files = sorted((tmp_path / "s").glob("*.json.gz"))
    assert len(files) == 3
    sinks.write_sharded(df, str(tmp_path / "s"), 20, append=True)
    assert spark.read.json(str(tmp_path / "s")).count() == 90
    sinks.write_partitioned(df, str(tmp_path / "t"), "tier")
    assert spark.read.json(str(tmp_path / "t")).where("tier = 1").count() == 22
    sinks.write_delimited_text(df, str(tmp_path / "u"))
    assert io.StringIO(next((tmp_path / "u").glob("*.txt")).read_text()).getvalue().count(sinks.DOCUMENT_END) == 45


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(6):
        spark.createDataFrame([(f"line {i} invalid user", i)], "text string, n int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + i))).coalesce(1).write.parquet(f"{src}/f{i}")
    schema = "text string, n int, ts timestamp"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    wrote = live.read_until(read(), str(tmp_path / "out"), str(tmp_path / "ck"), text_col="text", target_bytes=50)
    assert wrote >= 50 and spark.read.parquet(str(tmp_path / "out")).count() < 6
    q = live.triage_stream(read(), "text", "ts").writeStream.format("memory").queryName("triage").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM triage WHERE family = 'failed_login'").first()[0] == 6
    q = live.dedup_stream(read().withColumn("text", F.lit("same")), "text", "ts").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 1


def test_composed_readers(spark, tmp_path):
    page = "# Title\n" + "see [link](http://x) " * 20
    archive(tmp_path / "org__repo.zip", {
        "root/docs/a.md": page, "root/docs/fr/b.md": page, "root/c.html": "<p>" + "word " * 60 + "</p><script>x</script>", "root/short.html": "<b>" * 60 + "few", "root/copy.txt": "same " * 50,
        "root/copy2.txt": "same " * 50, "root/late.py": "x = 1\n" * 1000 + "\0",
    })
    one = {r.path: r.text for r in archives.repository_texts(spark, str(tmp_path), (".md", ".py")).collect()}
    assert set(one) == {"docs/a.md", "docs/fr/b.md"} and one["docs/a.md"].startswith("# dosya: docs/a.md\n# Title\nsee link ")
    two = {r.source: r.text for r in archives.corpus_texts(spark, str(tmp_path)).collect()}
    assert set(two) == {"org__repo:docs/a.md", "org__repo:c.html", "org__repo:copy.txt", "org__repo:late.py"}  # docs/fr/b.md and copy2.txt are copies
    assert two["org__repo:c.html"].startswith("word word") and "script" not in two["org__repo:c.html"]
    three = {(r.source, r.kind) for r in archives.retrieval_texts(spark, str(tmp_path), (".md",), F.col("path").startswith("docs/")).collect()}
    assert three == {("repo:docs/a.md", "md")}


def test_vulnerability_archive(spark, tmp_path):
    record = '{"cveMetadata": {"cveId": "CVE-2020-1", "state": "PUBLISHED"}, "containers": {"cna": {"descriptions": [{"lang": "en", "value": "a flaw of twenty characters or more"}]}}}'
    archive(tmp_path / "list.zip", {"top/cves/2020/0xxx/CVE-2020-1.json": record, "top/cves/2020/0xxx/CVE-2020-2.json": "broken", "top/cves/delta.json": record, "top/other/CVE-2020-3.json": record})
    (got,) = archives.cve_texts(spark, str(tmp_path)).collect()
    assert got.source == "CVE:CVE-2020-1.json" and got.text.startswith("CVE-2020-1 (PUBLISHED)")


def test_train_folders_are_preferred(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/d/test/x")
    assert [r.a for r in records.read_parquet_rows(spark, f"{tmp_path}/d").collect()] == [1]
    spark.createDataFrame([(2,)], "a int").write.parquet(f"{tmp_path}/d/train/x")
    assert [r.a for r in records.read_parquet_rows(spark, f"{tmp_path}/d").collect()] == [2]


def test_token_ids_and_files_of_a_corpus(spark, tmp_path):
    import os

    import numpy as np

    from corpusloom.operators import reports

    sinks.write_token_ids(spark.createDataFrame([([1, 65535, 7],), ([],)], "ids array<int>"), f"{tmp_path}/ids")
    assert sorted(np.frombuffer(r.ids, "<u2").tolist() for r in spark.read.parquet(f"{tmp_path}/ids").collect()) == [[], [1, 65535, 7]]
    os.mkdir(tmp_path / "c")
    for name, lines in {"korpus_0001.jsonl.gz": '{"metin": "şa"}\n\n', "korpus_0002.jsonl.gz": '{"metin": "b"}\nbroken\n', "korpus_cve_0001.jsonl.gz": '{"metin": "cc"}\n{"kaynak": "x"}\n'}.items():
        with gzip.open(tmp_path / "c" / name, "wt") as f:
            f.write(lines)
    got = {r.grp: (r.files, r.docs, r.bytes, r.disk_bytes) for r in reports.corpus_files(spark, f"{tmp_path}/c", F.when(F.col("name").startswith("korpus_cve_"), "cve").otherwise("main")).collect()}
    size = lambda *names: sum(os.path.getsize(tmp_path / "c" / n) for n in names)
    assert got["main"] == (2, 2, 4, size("korpus_0001.jsonl.gz", "korpus_0002.jsonl.gz")) and got["cve"] == (1, 2, 2, size("korpus_cve_0001.jsonl.gz")) and got[None][:3] == (3, 4, 6)
