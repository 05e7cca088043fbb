"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for candidates. A candidate's value is hashed, and the hashes are counted
by distinct owners and distinct repositories over the whole corpus: values that many owners share are
copied examples; values of few owners that also look random are live-looking credentials.

Null and empty texts hold nothing; very long texts are scanned whole. A null owner or repository counts
as one owner of its own. Repeated rows are scanned and returned each; they add no owner. Spans of one
start stand in the order of the kinds. Only the id, the text and what the owner expressions name are
read, so other names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, join_classes, quoted
from .sketch import split_by_keys
from .words import slices

#: Kinds in the order that breaks ties of equal starts; the first three are the base ones.
KINDS = ("assign", "access", "hex", "google", "slack", "github", "jwt", "pem")
BASE = 3
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_REST = {
    "access": ("AKIA", re.compile(r"AKIA[A-Z0-9]{12,}")),
    "hex": ("", re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")),
    "google": ("AIza", re.compile(r"AIza[0-9A-Za-z_-]{35}")),
    "slack": ("xox", re.compile(r"xox[baprs]-[0-9A-Za-z-]{10,}")),
    "github": ("gh", re.compile(r"gh[pousr]_[0-9A-Za-z]{36,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,}")),
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----")),
}


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every candidate in a text, in that order; code points, end exclusive."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for k, name in enumerate(KINDS[1:], 1):
        mark, pattern = _REST[name]
        if mark in text:
            out += [(m.start(), k, m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("entropy", pa.float64())])


def scan(docs: DataFrame, id_col: str, text_col: str, owner: str, repository: str) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [candidates(t) for t in batch.column("text").to_pylist()]
            base = [[x[:3] for x in f if x[1] < BASE] for f in found]
            counts = [Counter(k for _, k, _ in b) for b in base]
            columns = [batch.column("id"), batch.column("text_md5"), batch.column("owner"), batch.column("repository")]
            columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE)]
            columns += [
                pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([[{"start": a, "kind": k, "stop": b, "value": hashlib.sha256(v.encode()).hexdigest(), "entropy": entropy(v)} for a, k, b, v in f] for f in found], pa.list_(_SPAN)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_md5", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text", f"md5(`{text_col}`) AS text_md5", f"coalesce(cast({owner} AS string), '') AS owner", f"coalesce(cast({repository} AS string), '') AS repository").mapInArrow(
        run, f"id {kind}, text_md5 string, owner string, repository string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<struct<start:int,kind:int,stop:int,value:string,entropy:double>>"
    )


def ownership(found: DataFrame) -> DataFrame:
    """value -> distinct owners, distinct repositories, occurrences. Repeats are folded before each shuffle."""
    each = found.select("owner", "repository", F.explode("found.value").alias("value")).groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: str = "source",
    example_owners: int = 3, example_repositories: int = 8, min_entropy: float = 2.5,
) -> DataFrame:
    """One row for each document: (id, n_assign, n_access, n_hex, base_sha256, spans, n_live, live, n_example, text_md5).

    `owner` and `repository` are SQL expressions over `docs`; repositories are counted within their owner.
    A value of at least `example_owners` owners or `example_repositories` repositories is a copied example.
    Any other whose entropy reaches `min_entropy` is live-looking. Base spans all stay in `spans`; spans of
    the further kinds are added if live-looking. `live` lists the live-looking spans.

    The one pass over texts is checkpointed; only candidates are shuffled. Verdicts of
    values that would crowd a task are broadcast when they are joined back, the others go by value.
    """
    found = cut(scan(docs, id_col, text_col, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    verdicts = cut(ownership(found).select("value", "n", ((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)).alias("example")))
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    carried = ["id", "text_md5", "n_assign", "n_access", "n_hex", "base_sha256"]
    spans = found.where(F.size("found") > 0).select("row", *carried, F.explode("found").alias("s"))
    spans = join_classes(spans.select("row", *carried, "s.*"), verdicts, "value", total)
    live = ~F.col("example") & (F.col("entropy") >= min_entropy)
    judged = spans.groupBy("row").agg(
        *(F.first(c).alias(c) for c in carried),
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop", live.alias("live"), "example"))).alias("all"),
    )
    none = found.where(F.size("found") == 0).select("row", *carried, F.expr("CAST(array() AS array<struct<start:int,kind:int,stop:int,live:boolean,example:boolean>>)").alias("all"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    everyone = judged.unionByName(none)
    return everyone.select(
        F.col("id").alias(id_col), *carried[2:],
        text(F.filter("all", lambda s: (s["kind"] < BASE) | s["live"])).alias("spans"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live"),
        text(F.filter("all", lambda s: s["live"])).alias("live"),
        F.size(F.filter("all", lambda s: s["example"])).cast("long").alias("n_example"), "text_md5",
    )


def mask(text: str | None, spans: str | None, label: str = "[SECRET]") -> str | None:
    """The text with the given spans, as written above, replaced; overlapping spans are one."""
    if not text or not isinstance(spans, str) or not spans:
        return text
    out, at = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_live(docs: DataFrame, scanned: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`docs`, in its columns, with the live-looking spans of `scanned` replaced.

    Spans go by the text's digest, so every row is masked by its own, whatever its id. Only rows of a
    digest that may have spans are joined; the others' texts are not shuffled.
    """
    digest, live = free_name(docs, "text_md5"), free_name(docs, "live")
    spans = cut(scanned.where(F.col("n_live") > 0).groupBy(F.col("text_md5").alias(digest)).agg(F.max("live").alias(live)))
    clean, few = split_by_keys(docs, F.md5(F.col(quoted(text_col))), spans.select(digest))

    @F.pandas_udf("string")
    def masked(text, live):
        return text.combine(live, mask)

    joined = few.withColumn(digest, F.md5(F.col(quoted(text_col)))).join(spans.hint("shuffle_hash"), digest, "left")
    marked = joined.select(*(masked(F.col(quoted(c)), F.col(live)).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns))
    return clean.unionByName(marked)
