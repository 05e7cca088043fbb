import hashlib
import random

import pytest

from corpusloom.llm import queries
from corpusloom.llm.reply_trees import chat_paths, conversation_tree, escape, escape_role, format_paths, read_back, turns, unescape

NASTY = [r"\### Assistant: </turn> ok", "", "\\", "\\\\", "#", "##", "####  ### x: ", "<", "</turn>", "<\\/turn>", "<<//turn>", "a\n### user: b</turn>\n", "ends \\", "ends #", "ends <", ": ", "x:: y", "é😀 \r\0"]


@pytest.mark.parametrize("text", NASTY)
def test_escapes_are_reversible_and_hide_marks(text):
    for f in (escape, escape_role):
        assert unescape(f(text)) == text and "</turn>" not in f(text) and "##" not in f(text)
    assert ": " not in escape_role(text)


def test_random_conversations_read_back():
    rng = random.Random(3)
    some = lambda: "".join(rng.choice(r"\#<:/ turn>" + "a\n") for _ in range(rng.randint(0, 30)))
    for _ in range(300):
        said = [(some(), some()) for _ in range(rng.randint(0, 5))]
        assert list(turns("".join(f"### {escape_role(r)}: {escape(t)}</turn>\n" for r, t in said))) == said


def tree(rng, n):
    """(id, parent, score) of a few trees, some parents not there."""
    rows = []
    for i in range(n):
        parent = None if rng.random() < 0.1 else rng.randrange(i) if i and rng.random() < 0.95 else 10_000 + i
        rows.append((i, parent, rng.choice([None, 0.0, 1.0, 2.5])))
    return rows


def brute_paths(rows, branches):
    ids = {i: (p, s or 0.0) for i, p, s in rows}
    up = {i: p for i, (p, _) in ids.items() if p in ids}
    out = {}
    for leaf in set(ids) - set(up.values()):
        path = [leaf]
        while path[-1] in up and len(path) <= len(ids):
            path.append(up[path[-1]])
        if len(path) <= len(ids):
            out.setdefault(path[-1], []).append((-sum(ids[x][1] for x in path) / len(path), leaf, path[::-1]))
    return {leaf: (root, n, path) for root, found in out.items() for n, (_, leaf, path) in list(enumerate(sorted(found), 1))[:branches]}


@pytest.mark.parametrize("branches", [1, 2, None])
def test_paths_against_brute_force(spark, branches):
    rng = random.Random(branches or 9)
    rows = tree(rng, 150) + [(500 + i, 499 + i if i else None, 1.0) for i in range(70)]  # and a long chain
    rows += [(900, 901, 1.0), (901, 900, 1.0), (902, 901, 1.0), (903, 903, 1.0)]  # cycles, and what hangs below one
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (None, None, None)], "id long, parent long, score double").repartition(3)
    got = {}
    for r in chat_paths(df, branches=branches).collect():
        got.setdefault(r.leaf, []).append((r.depth, r.node, r.root, r.branch))
    want = brute_paths(rows, branches)
    assert {leaf: [n for _, n, *_ in sorted(g)] for leaf, g in got.items()} == {leaf: path for leaf, (_, _, path) in want.items()}
    for leaf, g in got.items():
        assert sorted(d for d, *_ in g) == list(range(len(g)))
        assert {(root, n) for *_, root, n in g} == {(want[leaf][0], None if branches is None else want[leaf][1])}


def expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", hashlib.md5(text.encode()).hexdigest() if text is not None else "", text or ""))
    out = {}
    for c, said in convs.items():
        said.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, r, _, t in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, _, t in said).encode()).hexdigest()
        chars = sum(len(f"### {escape_role(r)}: {escape(t)}</turn>\n") for _, r, _, t in said)
        out[c] = (len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_query(spark, tmp_path):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(NASTY) + str(t)) for c in range(30) for t in rng.sample(range(-5, 40), rng.randint(1, 9))]
    rows += [(40, t, "assistant" if t % 2 else "user", f"turn {t} " * 50) for t in range(130)]  # long chain
    rows += [(41, 1, "user", "twice"), (41, 1, "user", "twice"), (41, 1, None, None), (41, 2, "assistant", None), (42, None, "assistant", "no turn"), (42, 0, "user", "x" * 3_000_000), (43, 0, "a: b", "role with a mark"), (None, 0, "user", "no conversation"), (None, 1, "assistant", "none")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, leaf string, part int").repartition(4)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    mark = r"\### Assistant: </turn> ok"
    out = queries.op12_chat_format(spark, str(tmp_path)).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in out}
    assert len(out) == len(got) and got == expected([*rows, (-7, 0, "user", mark), (-7, 1, "assistant", mark)])


def test_parts_of_long_paths_and_stored_rows(spark, tmp_path):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {c} {t} ### " * (t + 1)) for c in range(5) for t in range(40)]
    nodes, said = conversation_tree(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    formatted = format_paths(chat_paths(nodes), said, name_col="conv_id", part_chars=300)
    formatted.write.parquet(f"{tmp_path}/f")
    stored = spark.read.parquet(f"{tmp_path}/f")
    assert stored.where("part > 3").count() > 0
    again = stored.repartition("leaf").sortWithinPartitions("leaf", "part")
    whole = read_back(format_paths(chat_paths(nodes), said, name_col="conv_id"))
    key = lambda d: sorted(tuple(r) for r in d.drop("leaf").collect())
    assert key(read_back(again)) == key(whole) and {r.name for r in whole.collect()} == set(range(5))


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes, said = conversation_tree(empty)
    assert read_back(format_paths(chat_paths(nodes), said)).count() == 0
