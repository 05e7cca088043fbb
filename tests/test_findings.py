"""Faults that a review found, on the smallest rows that show them."""

import hashlib
import os
import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import text
from corpusloom.operators import blockmax, grounding, tokenstream
from corpusloom.sources import archives, sinks
from corpusloom.streaming import live


def both(spark, tmp_path, name, **tables):
    """A query's rows from Spark and from its SQL, over these tables alone."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, want = catalog.queries()[name](spark, str(tmp_path)), duck.execute(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str), sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)


def test_qa_curate_keeps_letters_of_two_capitals(spark, tmp_path):
    rows = [(5, 0, "user", "Schßer und mehr"), (5, 1, "assistant", "eins"), (10, 0, "user", "ŉﬁßǰᾳ?"), (10, 1, "assistant", "zwei"), (15, 0, "user", "SCHẞER"), (15, 1, "assistant", "drei"), (6, 0, "user", "straße"), (6, 1, "assistant", "vier")]
    got, want = both(spark, tmp_path, "qa_curate", conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == want and len(got) == 3


def test_capitals_by_letter_are_those_of_the_sql(spark):
    codes = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c, chr(c)) for c in codes], "i int, c string").select("i", text.upper_by_letter(F.col("c"))).collect()
    assert dict(map(tuple, got)) == dict(duckdb.connect().execute("SELECT i::INT, upper(chr(i::INT)) FROM (SELECT unnest(?) AS i)", [codes]).fetchall())


def test_decode_multi_takes_whole_texts(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(["short", "ä€😀 %41+" * 3000, "a\tb " * 70_000, " x", " spaced ", "", None])]
    got, want = both(spark, tmp_path, "decode_multi", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got == want


@pytest.mark.parametrize("gram", [3, 16])
def test_topics_of_long_keywords_are_found_by_their_rarest_gram(spark, gram):
    rng = random.Random(gram)
    texts = ["".join(rng.choice("aab é") for _ in range(rng.randint(0, 90))) for _ in range(80)] + ["x" * ((1 << 20) - 9) + "over the border of a stretch" + "y" * 40, "", None]
    keywords = sorted({t[a : a + rng.randint(1, 25)] for t in texts[:80] for a in range(0, len(t), 11)}) + ["er the border of a str", "the border", "er the border of a strX", "zz"]
    topics = [(f"s{i % 30}", k.upper() if i % 3 else k) for i, k in enumerate(keywords)]
    docs = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "id int, back int, text string").repartition(4)
    mapping = {}
    for slug, k in topics:
        mapping.setdefault(slug, []).append(k.lower())
    for order in (["id"], ["back", "id"]):
        more = dict(id_col="id", text_col="text", per_topic=3, max_chars=30, order=order)
        want = sorted(map(tuple, grounding.ground_topics(docs, mapping, **more).collect()))
        got = grounding.ground_table(docs, spark.createDataFrame(topics, "slug string, keyword string"), **more, gram=gram)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 80


def test_topics_make_no_row_for_each_gram_of_a_text(spark):
    """Candidates are runs that are keywords themselves, not texts that share four characters with one."""
    docs = spark.createDataFrame([(i, "lorem ipsum dolor sit amet " * 20) for i in range(50)], "id int, text string")
    low = docs.select(F.col("id").alias("_id"), F.lower("text").alias("low"))
    words = spark.createDataFrame([("lorem ipsum at",), ("dolor sit amet",)], "gram string")
    found = grounding._hits(low, words, [14]).groupBy("gram").count().collect()
    assert [tuple(r) for r in found] == [("dolor sit amet", 50)]


def test_postings_are_stored_in_few_bytes(spark):
    """A posting took over 50 bytes in a checkpoint, and its queries' hits were shuffled."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(120))) for i in range(600)], "id int, text string")
    index = blockmax.block_index(docs, "id", "text", per_block=16)
    files = [f.removeprefix("file:") for f in index.postings.inputFiles()]
    postings = index.postings.agg(F.sum(F.size("entries"))).first()[0]
    assert files and sum(os.path.getsize(f) for f in files) < 15 * postings


@pytest.mark.parametrize("rows,files", [(0, 3), (2, 5), (500, 4)])
def test_parts_of_a_stream_are_so_many_files(spark, tmp_path, rows, files):
    """A part was one file, written by one task."""
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sinks.write_files(df, f"{tmp_path}/f", files, "doc_id")
    assert len(list((tmp_path / "f").glob("part-*.parquet"))) == files
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/f").collect()) == list(range(rows))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/f")
    assert live.read_until(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", text_col="text", target_bytes=max(1, rows // 2)) == rows


def test_token_stream_is_packed_in_small_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[7] * 4096] * 100, pa.list_(pa.int32()))], names=["stretch", "ids"])
    pieces = list(tokenstream._slices(iter([batch]), 100_000))
    assert max(p.num_rows for p in pieces) < 10 and pa.Table.from_batches(pieces).combine_chunks() == pa.Table.from_batches([batch])


def test_a_large_archive_is_written_by_many_tasks(spark, tmp_path):
    files = [(a, f"top/d{i % 3}/{i}.md", f"{i} text " * 40) for i in range(200) for a in ("big.zip", "b.zip") if a == "big.zip" or i < 3]
    archives.write_archives(spark.createDataFrame(files, "archive string, path string, text string"), str(tmp_path / "z"), volume_bytes=8_000)
    volumes = sorted((tmp_path / "z").rglob("*.zip"))
    assert len([v for v in volumes if v.name == "big.zip"]) > 5 and len([v for v in volumes if v.name == "b.zip"]) == 1
    got = archives.read_archives(spark, str(tmp_path / "z"), min_bytes=0).select("archive", "path", "text").collect()
    assert sorted(map(tuple, got)) == sorted((a, p.split("/", 1)[1], t) for a, p, t in files)


def test_a_text_is_digested_once_not_for_each_word(spark):
    docs = spark.createDataFrame([(1, "Haus und haus"), (2, None)], "id int, text string")
    asked = text._asked_words(docs, "text")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.word for r in asked.collect()) == ["haus", "und"] and 0 <= plan.index("Generate") < plan.index("md5(")


def test_dict_table_takes_rows_as_its_sql(spark, tmp_path):
    """Null and empty texts had a row, texts of one id had a row each, and words beside capitals of which the lower case is ASCII were cut otherwise."""
    words = "stanbul istanbul kelvin elvin haus mouse zebra ik kk iki wer das und aber alfa beta gamma"
    rows = [(1, words), (2, None), (3, ""), (4, "İstanbul STANBUL Istanbul aberİstanbul"), (5, "\u212aelvin Elvin KELVIN elvin"), (6, "haus\u212a\u212aMouse zebra\u0130\u212awer, \u212a\u212a"), (7, "Haus und MOUSE, aber"), (7, "Haus und MOUSE, aber"), (7, None), (8, ""), (8, "Das Zebra"), (None, "wer UND was"), (9, "42 !?")]
    got, want = both(spark, tmp_path, "dict_table", documents=spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert got == want and len(got) == 8
    none, wanted = both(spark, tmp_path / "none", "dict_table", documents=spark.createDataFrame([(1, "Haus und aber"), (2, ""), (3, None)], "doc_id long, text string"))
    assert none == wanted and len(none) == 1


def test_texts_of_one_id_are_put_together_in_stored_order(spark, tmp_path):
    rows = [(1, "7 ef"), (None, "1 2"), (1, "8-gh-9"), (None, "3"), (2, "5")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    fix = lambda w: w[::-1] + "ş" if hashlib.md5(w.encode()).hexdigest() < "8" else w
    want = {1: f"7 8-{fix('ef')}{fix('gh')}-9", None: "1 23", 2: "5"}
    assert {r.doc_id: r.text_md5 for r in catalog.queries()["dict_table"](spark, str(tmp_path)).collect()} == {k: hashlib.md5(v.encode()).hexdigest() for k, v in want.items()}


def test_lower_case_by_letter_is_that_of_the_sql_where_it_is_ascii(spark):
    codes = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    ascii_of = lambda pairs: {i: c for i, c in pairs if c.isascii()}
    got = spark.createDataFrame([(c, chr(c)) for c in codes], "i int, c string").select("i", text.lower_by_letter(F.col("c"))).collect()
    assert ascii_of(map(tuple, got)) == ascii_of(duckdb.connect().execute("SELECT i::INT, lower(chr(i::INT)) FROM (SELECT unnest(?) AS i)", [codes]).fetchall())


@pytest.fixture
def parts(spark, tmp_path):
    """Reads a stream of five files of 20 bytes into a folder of a name."""
    for i in range(5):
        spark.createDataFrame([(f"{i}" * 20,)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    read = lambda: spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    return lambda name, target, change=lambda s: s, **k: live.read_until(change(read()), f"{tmp_path}/{name}", f"{tmp_path}/{name}-ck", text_col="text", target_bytes=target, **k)


def test_a_bounded_read_out_of_time_is_no_result(spark, tmp_path, parts):
    """It returned the bytes so far, as if the stream had no more."""
    with pytest.raises(TimeoutError):
        parts("out", 100, timeout=0)
    assert parts("out", 100) == 100 and spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert parts("all", 1000) == 100 == parts("all", 1000) and spark.read.parquet(f"{tmp_path}/all").count() == 5


def test_a_bounded_read_that_fails_is_no_result(spark, tmp_path, parts, monkeypatch):
    """A query that failed between two looks at it was taken for one without more rows."""
    kind = type(spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/any").start())
    for q in spark.streams.active:
        q.stop()
    true = kind.awaitTermination

    def late(self, timeout=None):
        out, until = true(self, 0.001), time.monotonic() + 60
        while not out and self.isActive and time.monotonic() < until:
            time.sleep(0.05)
        return out

    monkeypatch.setattr(kind, "awaitTermination", late)
    broken = lambda s: s.withColumn("text", F.when(F.col("text").startswith("2"), F.raise_error(F.lit("broken row"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken row"):
        parts("out", 100, broken)
    monkeypatch.undo()
    assert parts("out", 100) == 100 and sorted(r.text[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list("01234")


def test_a_bounded_stream_reads_on_at_half_a_byte_less(spark, tmp_path):
    """Half of three bytes was one, so a part too few was read."""
    got, want = both(spark, tmp_path, "bounded_stream", documents=spark.createDataFrame([(0, "a"), (1, "bc"), (3, "")], "doc_id long, text string"))
    assert got == want and len(got) == 2


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(-1, "ab"), (None, "abcd"), (0, "a"), (7, None), (2, "abc"), (3, "z")]])
def test_a_bounded_stream_of_few_rows(spark, tmp_path, rows):
    """A table without text had no result, and ids below 0 were in no part."""
    got, want = both(spark, tmp_path, "bounded_stream", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want
