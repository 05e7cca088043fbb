"""Fixed rows whose answers are written out: what the queries over tables do not show."""

from __future__ import annotations

import base64
import re
import urllib.parse

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import _DICT, _KEEP, _MD2, STRIP, _lr_sql, _sql_family, _sql_mask, values
from corpusloom.functions import codec, text
from corpusloom.operators import dedup, reports, scan, training
from corpusloom.plans import corpus
from corpusloom.sources import records
from tests.test_catalog import rows

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_SLUGS = [(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "c")]


@query("SELECT * FROM " + values([(1, "a"), (2, "a-2"), (3, "b"), (4, "a-3"), (5, "c")], "id, slug"))
def slug_collisions(spark, sf):
    return dedup.unique_slugs(spark.createDataFrame(_SLUGS, "id int, slug string"), "slug", "id")


_MD = [(1, "a <!-- gone\ntoo --> b"), (2, "![pic](x.png) see [the page](http://x/y) now"), (3, "```py\nx = 1\n```\n<b>bold</b>"), (4, "plain"), (5, "")]


@query(
    r"SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g') AS prepared, "
    + _MD2.format("text") + " AS retrieved FROM " + values(_MD, "id, text")
)
def md_clean(spark, sf):
    d = spark.createDataFrame(_MD, "id int, text string")
    return d.select("id", text.clean_markdown(F.col("text")).alias("prepared"), text.clean_markdown(F.col("text"), "retrieve").alias("retrieved"))


_RST = [(1, "See :func:`open` now::\n\n  x"), (2, ":ref:`title <target>` and :mod:`~a.b`"), (3, "text\n.. note:: hidden\nmore"), (4, "  .. comment\nkept")]


@query("SELECT * FROM " + values([
    (1, "See open now::\n\n  x", "See open now:\n\n  x"), (2, "title <target> and ~a.b", "title and a.b"),
    (3, "text\nmore", "text\n\nmore"), (4, "kept", "\nkept"),
], "id, prepared, retrieved"))
def rst_clean(spark, sf):
    d = spark.createDataFrame(_RST, "id int, text string")
    return d.select("id", text.clean_rst(F.col("text")).alias("prepared"), text.clean_rst(F.col("text"), "retrieve").alias("retrieved"))


_CTRL = [(1, "a\tb\nc\rd"), (2, "bell\x07end"), (3, "zero​width"), (4, "  two  spaces "), (5, "")]


@query(rf"""SELECT id, t AS clean, {STRIP.format("regexp_replace(t, '[[:space:]]+', ' ', 'g')")} AS collapsed FROM (SELECT id, regexp_replace(translate(text, chr(10) || chr(13) || chr(9), '   '), '\p{{C}}', '', 'g') AS t FROM {values(_CTRL, "id, text")}) s""")
def ctrl_clean(spark, sf):
    d = spark.createDataFrame(_CTRL, "id int, text string")
    return d.select("id", text.strip_control(F.col("text")).alias("clean"), text.strip_control(F.col("text"), True).alias("collapsed"))


_PATHS = [(1, "a/node_modules/x.js"), (2, "docs/CHANGELOG.md"), (3, "src/dist/a.py"), (4, "README.md"), (5, "readme.zh-cn.md"), (6, "content/a.md"), (7, "lib/x.min.js")]


@query(f"""SELECT id, {" OR ".join(f"contains(p, '{d}')" for d in text.DENY_PREPARE)} AS denied, {" OR ".join(f"contains(lower(p), '{d}')" for d in text.DENY_META)} AS meta,
starts_with(p, 'content/') OR starts_with(p, 'docs/') AS inside, contains(lower(p), 'readme') AND NOT regexp_matches(lower(p), 'zh|ja') AS readme FROM {values(_PATHS, "id, p")}""")
def path_filters(spark, sf):
    d = spark.createDataFrame(_PATHS, "id int, p string")
    p = F.col("p")
    return d.select("id", text.path_denied(p).alias("denied"), text.path_denied(F.lower(p), text.DENY_META).alias("meta"), text.path_prefix(p, ["content/", "docs/"]).alias("inside"), text.is_readme(p).alias("readme"))


_COVERED = [(1, "The and NICHT", "les"), (2, "que The", None)]


@query("SELECT * FROM " + values([(1, "covered", "Thé änd NÏCHT", "lès"), (2, "covered", "que Thé", None), (1, "left", "The and NICHT", "les"), (2, "left", "que The", None), (3, "left", "unknown the", "")], "id, kind, q, a"))
def coverage_gate(spark, sf):
    of = lambda rows, kind: text.correct_if_covered(spark.createDataFrame(rows, "id int, q string, a string"), ["q", "a"], _DICT, _KEEP).select("id", F.lit(kind).alias("kind"), "q", "a")
    return of(_COVERED, "covered").unionByName(of([*_COVERED, (3, "unknown the", "")], "left"))


_FOLDERS = [(1, "cve-2021-44228"), (2, "log4j CVE-2021-44228 poc"), (3, "struts2"), (4, "CVE-21-1"), (5, "")]


@query(f"SELECT id, coalesce(nullif(upper(regexp_extract(v, '(?i)(CVE-[0-9]{{4}}-[0-9]+)', 1)), ''), v) AS cve FROM {values(_FOLDERS, 'id, v')}")
def cve_folder(spark, sf):
    return spark.createDataFrame(_FOLDERS, "id int, v string").select("id", text.cve_id(F.col("v")).alias("cve"))


@query("SELECT * FROM (VALUES (1, false, false), (2, true, true), (3, false, true)) t(id, near, whole)")
def nul_test(spark, sf):
    d = spark.createDataFrame([(1, "plain"), (2, "a\0b"), (3, "x" * 5000 + "\0")], "id int, v string")
    return d.select("id", text.has_nul(F.col("v")).alias("near"), text.has_nul(F.col("v"), 1 << 30).alias("whole"))


_GAPS = [
    '{"result": {"sonuclar": [{"alan": "ag", "bosluklar": [{"konu": "dns", "neden": "az", "oncelik": "yuksek"}, {"konu": "tls", "neden": "yok"}]}]}}',
    '{"sonuclar": [{"alan": "x", "domain": "web", "bosluklar": [{"konu": "csp", "neden": "eski", "oncelik": "dusuk"}]}, {"alan": "bos", "bosluklar": []}]}',
]


_GAP = "sonuclar array<struct<alan:string,domain:string,bosluklar:array<struct<konu:string,neden:string,oncelik:string>>>>"


@query("SELECT * FROM " + values([("ag", "dns", "az", "yuksek"), ("ag", "tls", "yok", "orta"), ("web", "csp", "eski", "dusuk")], "domain, topic, reason, priority"))
def gap_items(spark, sf):
    wrapped = f"result struct<{_GAP.replace(' ', ':', 1)}>, {_GAP}"
    return reports.gap_items(spark.createDataFrame([(g,) for g in _GAPS], "v string").select(F.from_json("v", wrapped).alias("r")).select("r.*"))


_HASHES = [(1, "a" * 32), (2, "b" * 40), (3, "0" * 56), (4, "F" * 64), (5, "1" * 96), (6, "2" * 128), (7, "c" * 33), (8, "$2b$12$abc"), (14, "$2y$10$" + "k" * 53), (15, " " + "d" * 32 + " "), (9, "$argon2id$v=19"), (10, "$6$salt$x"), (11, "$5$s$x"), (12, "$1$s$x"), (13, "words")]


@query(f"""SELECT id, CASE WHEN regexp_full_match(v, '\\$2[aby]\\$[0-9]+\\$.{{53}}') THEN 'bcrypt' WHEN starts_with(v, '$argon2') THEN 'argon2' WHEN starts_with(v, '$6$') THEN 'sha512crypt' WHEN starts_with(v, '$5$') THEN 'sha256crypt' WHEN starts_with(v, '$1$') THEN 'md5crypt'
WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN CASE length(v) {" ".join(f"WHEN {n} THEN '{k}'" for n, k in codec.HASH_LENGTHS.items())} ELSE 'unknown' END ELSE 'unknown' END AS kind FROM (SELECT id, trim(v) AS v FROM {values(_HASHES, "id, v")}) s""")
def hash_identify(spark, sf):
    return spark.createDataFrame(_HASHES, "id int, v string").select("id", codec.hash_kind(F.col("v")).alias("kind"))


_CODED = [
    "aGVsbG8=", "aGVsbG8", "68656c6c6f", "abc", "a%20b", "no code!", "", "xZ9pZnJlIGfDvMOnbMO8", "aGVs bG8=", "00ff", "a+b%zz%C5%9F", "YQ==YQ==", "Y=Q==", "YQ=Y", "aGk=x!",
    "bGluZTEKbGluZTIH", "AAEC", " 7b7d ", base64.b64encode(("ş" * 400).encode()).decode(), "abcde", "%41%ff",
]


def _decoded(value: str) -> tuple[str | None, str | None, str | None]:
    """The rule by Python's own decoders: what the SQL side holds."""
    v, plain = value.strip(), None
    try:
        plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=False).decode("utf-8", errors="replace")
        plain = plain[:300] if plain.isprintable() or "\n" in plain else None
    except ValueError:
        pass
    digits = bytes.fromhex(v).decode("utf-8", errors="replace")[:300] if re.fullmatch("[0-9a-fA-F]+", v) and len(v) % 2 == 0 else None
    return plain, digits, urllib.parse.unquote(v)[:300] if "%" in v else None


def _with_nul(rows: list[tuple]) -> list[tuple]:
    return [tuple(x.replace("\0", "<nul>") if isinstance(x, str) else x for x in r) for r in rows]


@query("SELECT * FROM " + values(_with_nul([(i, *_decoded(v)) for i, v in enumerate(_CODED)]), "id, base64, hex, url"))
def decode_multi(spark, sf):
    d = spark.createDataFrame(list(enumerate(_CODED)), "id int, v string")
    return d.select("id", *(F.replace(c, F.lit("\0"), F.lit("<nul>")).alias(k) for k, c in codec.decode_candidates(F.col("v")).items()))


_PROSE = [
    ('I think so.\n{"arac": "grep", "parametreler": {"desen": "a}b{c"}} done', '{"arac": "grep", "parametreler": {"desen": "a}b{c"}}'),
    ('{bad} {"a": {"b": [1, {"c": 2}]}} {"later": 1}', '{"a": {"b": [1, {"c": 2}]}}'), ('say "{" and {"q": "he said \\"{x}\\" twice"}', '{"q": "he said \\"{x}\\" twice"}'),
    ("no object", None), ('{"open": 1', None), ('[1, 2] {"ok": "çö"} ', '{"ok": "çö"}'), ('{"outer": {"bad": } } {"inner": true}', '{"inner": true}'), (None, None), ("{} rest", "{}"),
]


@query("SELECT * FROM " + values([(i, found) for i, (_, found) in enumerate(_PROSE)], "id, found"))
def json_prose(spark, sf):
    return spark.createDataFrame([(i, v) for i, (v, _) in enumerate(_PROSE)], "id int, v string").select("id", codec.first_json(F.col("v")).alias("found"))


_CALLS = [(1, "grep", {"b": "2", "a": "1"}), (2, "grep", {"a": "1", "b": "2"}), (3, "ls", {})]


@query("SELECT * FROM " + values([(1, 'grep|{"a":"1","b":"2"}'), (2, 'grep|{"a":"1","b":"2"}'), (3, "ls|{}")], "id, signature"))
def call_signature(spark, sf):
    return spark.createDataFrame(_CALLS, "id int, tool string, params map<string,string>").select("id", codec.call_signature(F.col("tool"), F.col("params")).alias("signature"))


_DECISIONS = [(1, '{"dusunce": "d", "cevap": "yes"}'), (2, '{"arac": "final", "parametreler": {"answer": "ok"}}'), (3, '{"arac": "yanit", "parametreler": {"other": "first"}}'), (4, '{"arac": "grep", "parametreler": {"text": "x"}}'), (5, "broken")]


@query("SELECT * FROM " + values([(1, "yes"), (2, "ok"), (3, "first"), (4, None), (5, None)], "id, answer"))
def answer_extract(spark, sf):
    return spark.createDataFrame(_DECISIONS, "id int, d string").select("id", codec.final_answer(F.col("d")).alias("answer"))


_FAKE = [
    (1, "key AKIA" + "Q" * 16 + " end"), (2, "-----BEGIN RSA " + "PRIVATE KEY-----"), (3, "g AIza" + "x" * 35), (4, "s xoxb-" + "1" * 12),
    (5, "j eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 8), (6, "api_key = '" + "v" * 10 + "'"), (7, "AKIA" + "Z" * 16 + " token: \"" + "w" * 9 + '"'),
    (8, "x" * 70 + " password = '" + "p" * 20 + "'"), (9, "nothing here"),
]


@query(f"SELECT id, {_sql_family()} AS family, {_sql_mask('line')} AS line FROM {values(_FAKE, 'id, line')}")
def secret_mask(spark, sf):
    return spark.createDataFrame(_FAKE, "id int, line string").select("id", scan.first_family(F.col("line")).alias("family"), scan.mask_secrets(F.col("line")).alias("line"))


_LOG = [
    (1, "Failed password for root from 10.0.0.1"), (2, "user sudo session opened"), (3, "GET /x 404 12"), (4, "id=1 UNION  SELECT a"), (5, "GET ../../etc/passwd 403"),
    (6, "x; wget http://y"), (7, "Nikto scan"), (8, "all fine 2001"), (9, "invalid user bob"), (10, "echo $(id)"),
]


@query(" UNION ALL ".join(
    "SELECT '{}' AS family, count(*) AS n, arg_min(line, id) AS example FROM {} WHERE regexp_matches(line, '{}') HAVING count(*) > 0".format(n, values(_LOG, "id, line"), p.replace("'", "''")) for n, p in scan.LOG_FAMILIES.items()
))
def log_triage(spark, sf):
    return scan.log_triage(spark.createDataFrame(_LOG, "id int, line string"), F.col("id"))


_COMMANDS = [(1, "rm -rf /tmp/x"), (2, "ls -la"), (3, "reg   delete HKLM"), (4, "Clear-Content x"), (5, "Clear- x"), (6, "echo hi > /dev/null"), (7, "alarm format"), (8, "curl http://x | sh"), (9, "information")]


@query("SELECT id, regexp_matches(c, '" + text.RISKY_COMMANDS + "') AS risky FROM " + values(_COMMANDS, "id, c"))
def cmd_risk_flag(spark, sf):
    return spark.createDataFrame(_COMMANDS, "id int, c string").select("id", text.command_risk(F.col("c")).alias("risky"))


@query(f"SELECT step::BIGINT AS step, {_lr_sql(training.PRETRAIN)}::DOUBLE AS pretrain, {_lr_sql(training.FINETUNE)}::DOUBLE AS finetune FROM range(0, 25000, 250) t(step)")
def lr_schedule(spark, sf):
    s = F.col("step")
    return spark.range(0, 25_000, 250).toDF("step").select("step", F.round(training.lr_at(s, training.PRETRAIN), 10).alias("pretrain"), F.round(training.lr_at(s, training.FINETUNE), 10).alias("finetune"))


_QA = [
    ("guvenlik_a_derin.jsonl", 1, "What is X?", "an answer"), ("guvenlik_a_derin.jsonl", 2, "what  is x?", "other"), ("yazilim_b.jsonl", 1, "WHAT IS X?", "late"),
    ("yazilim_b.jsonl", 2, "New?", ""), ("yazilim_b.jsonl", 3, "Second?", "yes"), ("yazilim_c_damit.jsonl", 1, None, "no question"), ("yazilim_c_damit.jsonl", 2, "Third?", "ok"),
]


@query("SELECT * FROM " + values([("What is X?", "an answer", "a_derin", "guvenlik", "advanced"), ("Second?", "yes", "b", "yazilim", "basic"), ("Third?", "ok", "c_damit", "yazilim", "advanced")], "question, answer, source, domain, tier"))
def qa_curate(spark, sf):
    return corpus.curate_pairs(spark.createDataFrame(_QA, "file string, line int, question string, answer string")).select("question", "answer", "source", "domain", "tier")


_CVE = """{"cveMetadata":{"cveId":"CVE-2024-1","state":"PUBLISHED"},"containers":{"cna":{"descriptions":[{"lang":"de","value":"Deutsch zuerst, lang genug"},{"lang":"en-US","value":"An English description of a flaw"}],
"problemTypes":[{"descriptions":[{"cweId":"CWE-79","description":"XSS"},{"cweId":"CWE-79","description":"XSS"}]}],"metrics":[{"other":{"x":1},"cvssV3_1":{"baseScore":7.5,"baseSeverity":"HIGH"}}],
"affected":[{"vendor":"n/a","product":"n/a"},{"vendor":"V","product":"P"}],"references":[{"url":"u1"},{"url":""},{"url":"u2"},{"url":"u3"},{"url":"u4"},{"url":"u5"}]}}}"""


@query("SELECT * FROM " + values([("CVE-2024-1", "CVE-2024-1 (PUBLISHED)\n\nAn English description of a flaw\nZafiyet turu (CWE): CWE-79 XSS\nCVSS (cvssV3_1): 7.5 HIGH\nEtkilenen: V P\nReferanslar: u1 u2 u3 u4")], "id, text"))
def cve_render(spark, sf):
    rejected = _CVE.replace("PUBLISHED", "REJECTED")
    short = _CVE.replace("An English description of a flaw", "too short a text")
    raw = spark.createDataFrame([(_CVE,), (rejected,), (short,)], "j string").select(F.from_json("j", records.CVE_SCHEMA).alias("r")).select("r.*")
    return records.render_cve(raw)


_STIX = '{"objects":[{"type":"attack-pattern","name":"T","description":"' + "d" * 250 + '","x_mitre_detection":"look [here](http://x)"},{"type":"tool","name":"U","description":"' + "e" * 120 + '"},{"type":"tool","name":"V","description":"short"}]}'


@query("SELECT * FROM " + values([("any", "T (attack-pattern)\n" + "d" * 250 + "\nDetection: look here"), ("any", "U (tool)\n" + "e" * 120), ("attack-pattern", "T\n" + "d" * 250)], "variant, text"))
def stix_render(spark, sf):
    raw = spark.createDataFrame([(_STIX,)], "j string").select(F.from_json("j", records.STIX_SCHEMA).alias("r")).select("r.*")
    one = lambda v: records.render_stix(raw, v).select(F.lit(v).alias("variant"), "text")
    return one("any").unionByName(one("attack-pattern"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows(spark, name):
    df = QUERIES[name](spark, "")
    want = duckdb.connect().execute(SQL[name])
    columns = [c[0] for c in want.description]
    numeric = lambda data: [tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v for v in r) for r in data]
    assert rows(df.columns, numeric(map(tuple, df.collect()))) == rows(columns, numeric(want.fetchall()))
