import hashlib
import re

from corpusloom.llm.secrets import KINDS, candidates, mask, scan_secrets

SCHEMA = "doc_id bigint, text string, source string, value string, live int"
KEY = "AKIA" + "QW3E" * 4
HEX = "0123456789abcdef" * 2
LIVE = "k9Xf27Qz81LmVb"


def brute(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


TEXTS = [
    f'password = "{LIVE}" and {KEY}', f"token:{HEX}", "PASSWD='short'", "password:token : abcdefgh1", "ſecret=abcdefghij", "secret=abcdefghij" * 3,
    "AKIAAKIA" + "X" * 20, "é" * 100 + f"api_key={LIVE}", f"apikey  =  '{LIVE}", HEX * 3 + "g" + HEX[:31], "", None, "x" * 200_000 + f" token={LIVE}", 'secret":"a.b-c=d/e+f_g',
]


def test_base_spans_against_brute_force():
    for t in TEXTS:
        assert [c[:3] for c in candidates(t) if c[1] < 3] == brute(t)


def rows(spark):
    out = [(i, t, f"s{i % 4}", "clash", 1) for i, t in enumerate(TEXTS)]
    out += [(100 + i, "see password=ExampleKey123 here", f"owner{i}", None, None) for i in range(6)]
    out += [(200, "password=own" + LIVE, "owner1", None, None), (201, "gh ghp_" + "aB3dE6gH9jK2" * 3, None, None, None), (7, TEXTS[7], "s1", None, None), (None, None, None, None, None)]
    return spark.createDataFrame(out, SCHEMA).repartition(3), out


def test_query(spark):
    df, given = rows(spark)
    got = scan_secrets(df).collect()
    assert len(got) == len(given)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in given:
        want = brute(t)
        r = by[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in want} <= set(r.spans.split(",")) | {""}
    assert by[100].n_example == 1 and by[100].n_live == 0 and by[200].n_live == 1
    assert "github" in by[201].spans and by[201].n_live == 1
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mask():
    assert mask("a secret b", "assign:2:8,hex:4:6") == "a [SECRET] b"
    assert mask(None, None) is None and mask("x", "") == "x"
