import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from corpusloom.llm import alignment  # noqa: E402
from corpusloom.llm.alignment import ByteBpe, PieceBpe, align  # noqa: E402

A, B = functools.partial(ByteBpe, P.path("byte_bpe_50k.json")), functools.partial(PieceBpe, P.path("piece_bpe_32k.model"))
TEXTS = [
    "Hello world, it's 2024!", "a  b   c\n\n d\te ", " leading", "naïve café 日本語 ελληνικά 😀 x", "<|endoftext|> and <s> </s> <unk> <0x41>", "=" * 90, "-=" * 60 + " z",
    "under▁score", "nul\0byte", "é ﬁ  nbsp  ", "tab\t\ttab \r\n x", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, " ", "x", "don't I'LL we've", "ﷺ ​ ﻿", "zq" * 400, "؀ःa b",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcde 's the\n\té日ß1.,-_▁<>|  ") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encoders_equal_the_libraries(library):
    t, m = library
    texts = TEXTS + random_texts(1500)
    a, b = A(), B()
    b.keep = 50
    for chunk in (texts[:700], texts[700:], texts[:100]):
        for text, x, y in zip(chunk, a.ids(chunk), b.ids(chunk), strict=True):
            if not text:
                assert x is None and y is None
                continue
            assert x.tolist() == t.encode(" " + text, add_special_tokens=False).ids
            want = m.encode(text)
            right = b"".join(b.spelled[i] for i in want) == b" " + text.encode()
            assert (y is not None) == right and (not right or y.tolist() == want), text


def brute(rows, library):
    """Per row: the contract's columns, by plain loops."""
    t, m = library
    spelled = A().spelled, B().spelled
    found = []
    for i, text in rows:
        groups = []
        if text:
            ids = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
            if all(b"".join(s[x] for x in side) == b" " + text.encode() for s, side in zip(spelled, ids, strict=True)):
                ends = [np.cumsum([len(s[x]) for x in side]).tolist() for s, side in zip(spelled, ids, strict=True)]
                at = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    group = []
                    for k in (0, 1):
                        to = ends[k].index(cut) + 1
                        group.append(ids[k][at[k] : to])
                        at[k] = to
                    groups.append(group)
        links = Counter((a, b) for x, y in groups for a in x for b in y)
        found.append((i, groups, links))
    held = Counter(p for _, _, links in found for p in links)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for i, groups, links in found:
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
            sum(n for (a, b), n in links.items() if held[a, b] == best[a]), sum(n * held[p] for p, n in links.items()), digest,
        ))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("more", [{}, {"stretch": 16}, {"most_pairs": 40}])
def test_query_against_brute_force(spark, library, more, monkeypatch):
    rows = list(enumerate(TEXTS + random_texts(120))) + [(900, None), (901, ""), (None, "no id"), (None, "other, without id"), (3, "same id"), (902, "twice it stands"), (902, "twice it stands")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, ids string, n_a int").repartition(5)
    got = align(df, A, B, with_groups=True, **more)
    assert got.columns == COLUMNS + ["groups"]
    collected = got.collect()
    assert ordered([tuple(r[c] for c in COLUMNS) for r in collected]) == ordered(brute(rows, library))
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_groups else "") for r in collected)


def test_vast_groups_and_few_links_at_a_time():
    rng = random.Random(5)
    one, two = np.array([1, 2, 3, 1]), np.array([1, 3, 2])  # bytes of each id
    for limit in (1, 3, 1 << 20):
        machine, texts, want = alignment.Sweep(one, two, True, limit), [], []
        for k in range(40):
            a = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
            n, b = int(one[a].sum()), []
            while n:
                b.append(rng.choice([x for x in range(3) if two[x] <= n]))
                n -= int(two[b[-1]])
            ends = np.cumsum(one[a]).tolist(), np.cumsum(two[b]).tolist()
            cuts, at, groups = sorted(set(ends[0]) & set(ends[1])), [0, 0], []
            for cut in cuts:
                to = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                at = to
            links = Counter(x * 3 + y for g in groups for x in g[0] for y in g[1])
            want.append((len(groups), sum(links.values()), sorted(links.items()), ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)))
            texts.append((alignment.Text((k,)), np.array(a), np.array(b)))
        machine.run(texts)
        assert [(t.n_groups, t.n_links, list(zip(t.pairs.tolist(), t.repeats.tolist(), strict=True)), ";".join(t.groups)) for t, _, _ in texts] == want


def test_links_table(spark, library):
    rows = [(1, "the cat"), (2, "the the"), (3, None)]
    docs = spark.createDataFrame(rows, "id int, text string").selectExpr("*", "xxhash64(text) AS text_hash", "octet_length(text) AS n_bytes")
    events = alignment.end_events(docs, A, 0).unionByName(alignment.end_events(docs, B, 1))
    a, b = A(), B()
    got = {(r.id, a.spelled[r.a], b.spelled[r.b]): r.n for r in alignment.links(alignment.sweep(events, a.sizes, b.sizes), len(b.sizes)).collect()}
    assert got == {(1, b" the", b" the"): 1, (1, b" cat", b" cat"): 1, (2, b" the", b" the"): 2}


def test_a_very_long_text_and_an_empty_table(spark, library):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    rows = [(1, long), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    t, m = library
    out = {r.doc_id: r for r in align(df, A, B, stretch=50_000).collect()}
    assert out[1] == {r.doc_id: r for r in align(df, A, B).collect()}[1]
    assert out[1].n_a == len(t.encode(" " + long).ids) and out[1].n_b == len(m.encode(long))
    assert align(df.limit(0), A, B).count() == 0
