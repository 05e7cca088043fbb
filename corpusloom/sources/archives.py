"""A Spark data source for zip archives of text files."""

from __future__ import annotations

import bz2
import io
import itertools
import os
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..checkpoints import checkpointed
from ..functions import text as T
from ..operators.dedup import keep_first
from .records import CVE_SCHEMA, render_cve

#: Extensions worth keeping in a training corpus.
CORPUS_EXTENSIONS = (
    ".md", ".rst", ".txt", ".adoc", ".rdoc", ".org", ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".cs", ".java", ".kt",
    ".c", ".h", ".cpp", ".hpp", ".cc", ".rb", ".php", ".swift", ".scala", ".lua", ".sh", ".ps1", ".sql", ".html", ".htm", ".css",
    ".yaml", ".yml", ".toml",
)
SCHEMA = "archive string, path string, size bigint, text string, error string"
DIRECTORY = "archive string, file string, path string, size bigint, at bigint, packed bigint, method int, checksum bigint, error string"


#: An entry of a vulnerability archive.
CVE_ENTRY = r"(?i)/cves/.*/CVE-\d+-\d+\.json$"


def unpacked(method: int, raw: bytes) -> bytes:
    """An entry's bytes; what cannot be unpacked raises."""
    if method == zipfile.ZIP_STORED:
        return raw
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(raw, -15)
    if method == zipfile.ZIP_BZIP2:
        return bz2.decompress(raw)
    raise NotImplementedError(f"compression {method}")


def text_of(raw: bytes, nul_in: int | None) -> str | None:
    """A file's text, bytes that are no UTF-8 left out; None if a NUL is among its first `nul_in` bytes, or anywhere where that is None."""
    return None if b"\x00" in (raw if nul_in is None else raw[:nul_in]) else raw.decode("utf-8", errors="ignore")


@dataclass(frozen=True)
class Rules:
    """Which files of an archive are rows; all is told by its directory but `nul_in`."""

    extensions: tuple[str, ...] = ()
    low: int = 120
    high: int = 3_000_000
    deny: tuple[str, ...] = ()
    fold_case: bool = True
    nul_in: int | None = 4096

    def wanted(self, info: zipfile.ZipInfo) -> str | None:
        """The file's path below the archive's top folder, or None."""
        path = info.filename.split("/", 1)[-1]
        test = path.lower() if self.fold_case else path
        if info.is_dir() or not self.low <= info.file_size <= self.high or any(d in test for d in self.deny):
            return None
        return path if not self.extensions or test.endswith(self.extensions) else None


def members(data: BinaryIO, name: str, rules: Rules) -> Iterator[tuple]:
    """Rows of an archive's text files. A corrupt archive is one row with its error; an entry that cannot be read is passed over."""
    try:
        with zipfile.ZipFile(data) as z:
            for info in z.infolist():
                if (path := rules.wanted(info)) is None:
                    continue
                try:
                    text = text_of(z.read(info), rules.nul_in)
                except (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError):
                    continue
                if text is not None:
                    yield name, path, info.file_size, text, None
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
        yield name, None, None, None, f"{type(e).__name__}: {e}"


def file_system(path: str):
    """(file system, path on it) of a URI or a local path; raises where Arrow knows no such file system."""
    from pyarrow import fs

    if (scheme := re.match(r"([a-z][a-z0-9+.-]*):", path)) and scheme[1] != "file":
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:(//)?(?=/)", "", path))


class _File(io.RawIOBase):
    """An Arrow file as Python's archive reader wants one: seeking to nowhere is an OSError."""

    def __init__(self, file):
        self.file = file

    def seekable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        return self.file.read(n if n >= 0 else None)

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.file.seek(at, whence)
        except ValueError as e:
            raise OSError(str(e)) from e

    def tell(self) -> int:
        return self.file.tell()


def _opens(path: str) -> bool:
    """Whether archives can be read by byte ranges there."""
    try:
        file_system(path)
    except (ValueError, OSError, NotImplementedError, ImportError):  # a scheme that only Spark's readers know
        return False
    return True


def read_archives(
    spark: SparkSession, path: str, *, extensions: tuple[str, ...] = (), min_bytes: int = 120, max_bytes: int = 3_000_000,
    deny: tuple[str, ...] = (), fold_case: bool = True, nul_in: int | None = 4096, where: Column | str | None = None, run_bytes: int = 64 << 20,
) -> DataFrame:
    """(archive, path, size, text, error) of the text files of all archives at `path`.

    The archives' directories are a table first; `where`, any condition over archive, path and size, is
    tested on it, so nothing of other files is read. What is left is dealt out by file and by slices of
    `run_bytes` of it, as many tasks as there are slices, each reading the ranges of its entries alone: one
    archive of any size is read by many tasks. On file systems that only Spark's own readers know, an
    archive is one task and is read whole, 2 GB at most.
    """
    rules = Rules(tuple(extensions), min_bytes, max_bytes, tuple(deny), fold_case, nul_in)
    where = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    if _opens(path):
        spark.dataSource.register(ZipDirectorySource)
        options = {"extensions": ",".join(rules.extensions), "minbytes": rules.low, "maxbytes": rules.high, "deny": ",".join(rules.deny), "foldcase": str(fold_case).lower()}
        entries = spark.read.format("zipdirectory").options(**options).load(path).where(where)
        packed = entries.agg(F.sum("packed")).first()[0] or 0
        columns = ["file", "path", "size", "at", "packed", "method", "checksum"]
        dealt = entries.where("error IS NULL").select(columns).repartition(packed // run_bytes + 1, "file", F.expr(f"at DIV {run_bytes}")).sortWithinPartitions("file", "at")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield from _in_batches(_texts(path, rows, nul_in))

        bad = entries.where("error IS NOT NULL").selectExpr("archive", "path", "size", "CAST(NULL AS string) AS text", "error")
        return dealt.mapInArrow(read, SCHEMA).unionByName(bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from _in_batches(members(io.BytesIO(data), name.rsplit("/", 1)[-1], rules))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA).where(where)


_ARROW = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("text", pa.string()), ("error", pa.string())])


def _in_batches(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += (row[2] or 0) + 100
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ZipTextSource(DataSource):
    """`spark.read.format("ziptext").load(folder)`: text files of zip archives, of any size, by byte ranges.

    Planning reads the archives' directories. Entries that are wanted by the options are put together to runs of about `runbytes` of packed bytes, in the order of
    their places; each run is a task, which reads the ranges of its entries alone.
    """

    @classmethod
    def name(cls) -> str:
        return "ziptext"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})


@dataclass
class Run(InputPartition):
    """Entries of one archive, as (path, size, place of the header, packed bytes, method, checksum), in the order of their places."""

    file: str
    entries: list[tuple[str, int, int, int, int, int]]
    error: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        split = lambda k: tuple(x for x in options.get(k, "").split(",") if x)
        nul_in = options.get("nulin", "4096")
        self.path, self.run_bytes = options["path"], int(options.get("runbytes", 64 << 20))
        self.rules = Rules(split("extensions"), int(options.get("minbytes", 120)), int(options.get("maxbytes", 3_000_000)), split("deny"), options.get("foldcase", "true") == "true", int(nul_in) if nul_in else None)

    def partitions(self) -> list[InputPartition]:
        out = [run for file in _archives(self.path) for run in self._runs(file)]
        return out or [Run("", [])]

    def _runs(self, file: str) -> Iterator[Run]:
        run, packed = [], 0
        for *_, path, size, at, length, method, checksum, error in _directory(self.path, file, self.rules):
            if error is not None:
                yield Run(file, [], error)
                continue
            if run and packed + length > self.run_bytes:
                yield Run(file, run)
                run, packed = [], 0
            run.append((path, size, at, length, method, checksum))
            packed += length + 100
        if run:
            yield Run(file, run)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        archive = partition.file.rsplit("/", 1)[-1]
        bad = [(archive, None, None, None, partition.error)] if partition.error is not None else []
        yield from _in_batches(itertools.chain(bad, _texts(self.path, ((partition.file, *e) for e in partition.entries), self.rules.nul_in)))


class ZipDirectorySource(DataSource):
    """`spark.read.format("zipdirectory").load(folder)`: what the directories of zip archives say of their files, a row each and a task for each archive."""

    @classmethod
    def name(cls) -> str:
        return "zipdirectory"

    def schema(self) -> str:
        return DIRECTORY

    def reader(self, schema) -> DataSourceReader:
        return _DirectoryReader({k.lower(): v for k, v in dict(self.options).items()})


class _DirectoryReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _archives(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from _directory(self.path, partition.value, self.rules)


def _archives(path: str) -> list[str]:
    from pyarrow import fs

    system, top = file_system(path)
    info = system.get_file_info(top)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and (x.path.endswith(".zip") or x.path == top))


def _directory(path: str, file: str, rules: Rules) -> Iterator[tuple]:
    """Rows of `DIRECTORY` of one archive's wanted files, in the order of their places; a corrupt archive is one row with its error."""
    archive = file.rsplit("/", 1)[-1]
    try:
        with file_system(path)[0].open_input_file(file) as data, zipfile.ZipFile(_File(data)) as z:
            infos = sorted(z.infolist(), key=lambda i: i.header_offset)
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
        yield archive, file, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
        return
    for info in infos:
        if (below := rules.wanted(info)) is not None and not info.flag_bits & 1:
            yield archive, file, below, info.file_size, info.header_offset, info.compress_size, info.compress_type, info.CRC, None


def _texts(path: str, entries: Iterable[tuple], nul_in: int | None) -> Iterator[tuple]:
    """Rows of `SCHEMA` of entries (file, path, size, place of the header, packed bytes, method, checksum); only their own ranges are read."""
    system, open_, data = None, None, None
    try:
        for file, below, size, at, length, method, checksum in entries:
            if file != open_:
                system = system or file_system(path)[0]
                if data is not None:
                    data.close()
                open_, data = file, system.open_input_file(file)
            try:
                head = data.read_at(30, at)
                skip = int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                raw = unpacked(method, data.read_at(length, at + 30 + skip))
                if head[:4] != b"PK\x03\x04" or len(raw) != size or zlib.crc32(raw) != checksum:
                    continue
            except (zlib.error, OSError, ValueError, NotImplementedError, EOFError):
                continue  # an entry that cannot be read is passed over, the others are not
            if (text := text_of(raw, nul_in)) is not None:
                yield file.rsplit("/", 1)[-1], below, size, text, None
    finally:
        if data is not None:
            data.close()


def write_archives(files: DataFrame, path: str, volume_bytes: int = 64 << 20) -> None:
    """(archive, path, text) rows as zip archives at `path`, file by file, in the order of paths.

    A zip archive is written by one task, so one of over `volume_bytes` of text is put into as many volumes:
    archives of the same name, the first in `path` and the others in folders below it, each written by a
    task of its own. Readers name files by their archive's name, so volumes read as one archive.
    """
    sizes = files.groupBy("archive").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("_bytes"))
    sizes = checkpointed(sizes.select("archive", (F.floor(F.col("_bytes") / volume_bytes) + 1).alias("_volumes")))
    tasks = sizes.agg(F.sum("_volumes")).first()[0] or 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(path)
        place, out, z = None, None, None
        for batch in batches:
            for archive, volume, below, text in zip(*(batch.column(c) for c in ("archive", "_volume", "path", "text")), strict=True):
                if (archive.as_py(), volume.as_py()) != place:
                    if z is not None:
                        z.close()
                        out.close()
                    place = archive.as_py(), volume.as_py()
                    folder = f"{top}/volume-{place[1]}" if place[1] else top
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{place[0]}")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(below.as_py()), (text.as_py() or "").encode(), zipfile.ZIP_DEFLATED)
        if z is not None:
            z.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([place and place[0]], pa.string())], names=["archive"])

    placed = files.select("archive", "path", "text").join(sizes, "archive").withColumn("_volume", F.pmod(F.xxhash64("path"), F.col("_volumes")))
    dealt = placed.select("archive", "_volume", "path", "text").repartition(4 * tasks, "archive", "_volume").sortWithinPartitions("archive", "_volume", "path")
    dealt.mapInArrow(write, "archive string").write.format("noop").mode("overwrite").save()


def labelled(df: DataFrame) -> DataFrame:
    """Corpus records (source, text) of archive rows: the source is archive stem and path."""
    return df.where("error IS NULL").select(F.concat(F.regexp_replace("archive", r"\.zip$", ""), F.lit(":"), "path").alias("source"), "text")


def repository_texts(spark: SparkSession, path: str, extensions: tuple[str, ...], path_filter: Column | None = None) -> DataFrame:
    """(archive, path, text) of repositories for training: files of 100 to 200,000 bytes without a NUL, Markdown and reStructuredText cleaned, each under its path. `path_filter` is over `path`."""
    df = read_archives(spark, path, extensions=extensions, min_bytes=100, max_bytes=200_000, deny=T.DENY_PREPARE, fold_case=False, nul_in=None, where=path_filter).where("error IS NULL")
    clean = F.when(F.col("path").endswith(".md"), T.clean_markdown(F.col("text"))).when(F.col("path").endswith(".rst"), T.clean_rst(F.col("text"))).otherwise(F.col("text"))
    return df.select("archive", "path", F.concat(F.lit("# dosya: "), F.col("path"), F.lit("\n"), clean).alias("text"))


def corpus_texts(spark: SparkSession, path: str, min_chars: int = 120) -> DataFrame:
    """(source, text) of archives for a corpus: files of known extensions, HTML stripped, `min_chars` or longer after it, the first of equal texts."""
    df = read_archives(spark, path, extensions=tuple(CORPUS_EXTENSIONS), deny=T.DENY_CORPUS).where("error IS NULL")
    is_html = F.lower("path").rlike(r"\.html?$")
    df = df.withColumn("text", F.when(is_html, T.clean_html(F.col("text"))).otherwise(T.strip(F.col("text")))).where(F.length("text") >= min_chars)
    return labelled(keep_first(df, F.md5("text"), ["archive", "path"]))


def retrieval_texts(spark: SparkSession, path: str, extensions: tuple[str, ...], path_filter: Column | None = None) -> DataFrame:
    """(source, kind, text) of archives for retrieval, as they stand; `build_chunks` cleans by `kind`: files of 200 to 400,000 bytes that are no translation, named by repository and path."""
    wanted = ~T.is_translation(F.col("path"))
    wanted = wanted if path_filter is None else wanted & path_filter
    df = read_archives(spark, path, extensions=extensions, min_bytes=200, max_bytes=400_000, fold_case=False, nul_in=0, where=wanted).where("error IS NULL")
    root = F.element_at(F.split(F.regexp_replace("archive", r"\.zip$", ""), "__"), -1)
    return df.select(F.concat(root, F.lit(":"), F.col("path")).alias("source"), F.element_at(F.split("path", r"\."), -1).alias("kind"), "text")


def cve_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of the records of vulnerability archives, rendered; entries of other names and broken records are passed over."""
    df = read_archives(spark, path, extensions=(".json",), min_bytes=0, max_bytes=1 << 40, nul_in=0, where=F.concat(F.lit("/"), F.col("path")).rlike(CVE_ENTRY))
    parsed = df.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.from_json("text", CVE_SCHEMA).alias("r")).select("file", "r.*")
    return render_cve(parsed.withColumn("cveMetadata", F.col("cveMetadata").withField("file", F.col("file"))), "cveMetadata.file").select(F.concat(F.lit("CVE:"), "id").alias("source"), "text")
