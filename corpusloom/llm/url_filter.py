"""URL filter by a temporal list join.

A list's entries are dated: at `since` a host is put on a list, or taken off it. The entries of each
host and list become validity intervals, and an as-of join judges every capture by the entries that
were active when it was fetched: those of its host and of each domain above it, the longest first.

Native DataFrame operations only. Captures with a null URL, one without a host, or a null fetch time
meet no entry and stay. Very long URLs are taken whole; only id, URL and time are read, so other names cannot clash. Entries that repeat, or that fall on one moment for one host and list, are one:
the blocking one. Null hosts, lists or times in entries are ignored. Repeated captures each return a
row. Empty tables give no rows, or leave every capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions


def host(url: Column) -> Column:
    """The lower-cased host of a URL, without user, port or trailing dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?:[:/?#]|$)", 1))


def domains(name: Column) -> Column:
    """A host and the domains above it, the longest first, the last of two labels."""
    labels = F.split(name, r"\.")
    cuts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1))
    return F.transform(cuts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(host, list, valid_from, valid_to) of the times at which an entry blocks, from (host, list, since, blocks); an open end is null."""
    dated = entries.where("host IS NOT NULL AND list IS NOT NULL AND since IS NOT NULL").groupBy("host", "list", "since").agg(F.max(F.coalesce("blocks", F.lit(False))).alias("blocks"))
    by = Window.partitionBy("host", "list").orderBy("since")
    return dated.withColumn("valid_to", F.lead("since").over(by)).where("blocks").select("host", "list", F.col("since").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", salts: int | None = None) -> DataFrame:
    """(id, fetched, n_active, kept, host_matched, list_matched) of each capture.

    `n_active` counts the active entries met; the match shown is of the longest domain, then the first
    list. Only keys of captures are shuffled, never pages. Domains are counted first: those of over one in
    p captures, with p shuffle partitions, are crowded. Their captures are spread over `salts` keys, a
    quarter as many as partitions unless given, to each of which the domain's intervals are copied; all
    others are joined once. Captures without a host are not joined.
    """
    p = partitions(captures.sparkSession)
    salts = salts or max(16, p // 4)
    keys = captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(time_col).alias("fetched"), host(F.col(url_col)).alias("name"))
    hostless = keys.where("name = '' OR fetched IS NULL").select("id", "fetched", F.lit(0).cast("long").alias("n_active"), F.lit(None).cast("struct<host:string,list:string>").alias("best"))
    # one row for each capture and domain
    tried = keys.where("name <> '' AND fetched IS NOT NULL").select("id", "fetched", "row", F.posexplode(domains(F.col("name"))).alias("depth", "host"))
    named = captures.where(F.col(time_col).isNotNull()).select(host(F.col(url_col)).alias("name")).where("name <> ''")
    each = named.groupBy("name").agg(F.count("*").alias("n")).select("n", F.explode(domains(F.col("name"))).alias("host")).groupBy("host").agg(F.sum("n").alias("n"))
    total = named.count()
    crowded = F.broadcast(each.where(F.col("n") * p > total).select("host", F.lit(True).alias("crowded")))  # at most p for each label of a host
    tried = tried.join(crowded, "host", "left").withColumn("salt", F.when(F.col("crowded"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).otherwise(0))
    copies = F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    active = intervals(entries).join(crowded, "host", "left").withColumn("salt", F.explode(copies)).drop("crowded")
    asof = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    met = tried.alias("t").join(active.alias("a"), (F.col("t.host") == F.col("a.host")) & (F.col("t.salt") == F.col("a.salt")) & asof, "left")
    best = F.min(F.when(F.col("a.list").isNotNull(), F.struct("t.depth", "a.list", F.col("t.host").alias("host"))))
    judged = met.groupBy("t.row", "t.id", "t.fetched").agg(F.count("a.list").alias("n_active"), best.alias("best"))
    judged = judged.select("id", "fetched", "n_active", F.struct("best.host", "best.list").alias("best")).unionByName(hostless)
    return judged.select(F.col("id").alias(id_col), "fetched", "n_active", (F.col("n_active") == 0).alias("kept"), F.col("best.host").alias("host_matched"), F.col("best.list").alias("list_matched"))


#: The generated lists of the query over `pages`: of ten hosts by hash three are listed, of ten domains one.
START = "2024-01-01"


def page_captures(pages: DataFrame) -> DataFrame:
    """`pages` with a fetch date, which the table lacks: a day of 2024 by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit(START).cast("date"), F.pmod(F.col("page_id") * 7, F.lit(366)).cast("int")).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts and domains met in `pages`: put on at one day by hash, off at a later one, on again at a third."""
    name = host(F.col("url"))
    named = pages.select(F.explode(F.array(F.struct(name.alias("host"), F.lit("hosts").alias("list"), F.lit(3).alias("share")), F.struct(F.get(F.reverse(domains(name)), F.lit(0)).alias("host"), F.lit("domains").alias("list"), F.lit(1).alias("share")))).alias("e")).select("e.*").where("host <> ''").distinct()
    digit = lambda salt, a, n: F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("host"))), a, n), 16, 10).cast("int")
    listed = named.where(digit("on:", 1, 4) % 10 < F.col("share"))
    first, second, third = digit("day:", 1, 4) % 200, digit("day:", 5, 4) % 100 + 1, digit("day:", 9, 4) % 60 + 1
    day = lambda n: F.date_add(F.lit(START).cast("date"), n)
    steps = F.array(F.struct(day(first).alias("since"), F.lit(True).alias("blocks")), F.struct(day(first + second).alias("since"), F.lit(False).alias("blocks")), F.struct(day(first + second + third).alias("since"), F.lit(True).alias("blocks")))
    return listed.select("host", "list", F.explode(steps).alias("s")).select("host", "list", "s.since", "s.blocks")


SQL = r"""
WITH p AS (SELECT page_id, DATE '2024-01-01' + (((page_id * 7) % 366)::INTEGER) AS fetched,
             lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?:[:/?#]|$)', 1)) AS name FROM pages),
tried AS (SELECT page_id, fetched, i - 1 AS depth, array_to_string(labels[i:], '.') AS host
          FROM (SELECT page_id, fetched, labels, unnest(range(1, greatest(2, len(labels)))) AS i FROM (SELECT *, string_split(name, '.') AS labels FROM p) t) t),
named AS (SELECT DISTINCT * FROM (
  SELECT name AS host, 'hosts' AS list, 3 AS share FROM p
  UNION ALL SELECT array_to_string(labels[greatest(1, len(labels) - 1):], '.') AS host, 'domains', 1 FROM (SELECT string_split(name, '.') AS labels FROM p) t) t WHERE host <> ''),
listed AS (SELECT host, list, ('0x' || substr(md5('day:' || host), 1, 4))::INTEGER % 200 AS a, ('0x' || substr(md5('day:' || host), 5, 4))::INTEGER % 100 + 1 AS b,
             ('0x' || substr(md5('day:' || host), 9, 4))::INTEGER % 60 + 1 AS c FROM named WHERE ('0x' || substr(md5('on:' || host), 1, 4))::INTEGER % 10 < share),
spans AS (SELECT host, list, DATE '2024-01-01' + a AS valid_from, DATE '2024-01-01' + (a + b) AS valid_to FROM listed
  UNION ALL SELECT host, list, DATE '2024-01-01' + (a + b + c), NULL FROM listed),
met AS (SELECT t.page_id, t.fetched, t.depth, t.host, s.list FROM tried t LEFT JOIN spans s ON t.host = s.host AND t.fetched >= s.valid_from AND (s.valid_to IS NULL OR t.fetched < s.valid_to))
SELECT page_id, fetched::VARCHAR AS fetched, count(list) AS n_active, count(list) = 0 AS kept,
  arg_min(host, depth * 10 + (list = 'hosts')::INTEGER) FILTER (WHERE list IS NOT NULL) AS host_matched,
  arg_min(list, depth * 10 + (list = 'hosts')::INTEGER) FILTER (WHERE list IS NOT NULL) AS list_matched
FROM met GROUP BY page_id, fetched"""
