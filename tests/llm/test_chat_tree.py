import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import chat_tree

ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi </s>[INST] \\ <s>"), (1, 2, "user", None),
    (2, 0, "user", "hello"), (2, 1, "assistant", "hi </s>[INST] \\ <s>"), (2, 2, "user", "more"), (2, 3, "assistant", "ä🙂"),
    (3, 0, "user", "hello"), (4, 0, "user", "hello"), (4, 1, "assistant", ""), (5, None, None, None),
    (5, 3, "assistant", "x" * 50000), (None, 0, "system", "[INST]"), (None, 0, "system", "[INST]"), (6, 0, "us", "erhello"),
]


def brute(rows):
    out = {}
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, own in turns.items():
        own.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        special = sum(c in "<[\\" for _, r, t in own for c in r + t)
        chars = sum(20 + len(r) + len(t) for _, r, t in own) + special
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha(whole), len(loss), sha(loss), chars)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))


def test_read_back(spark):
    got = {r[0]: tuple(r[1:]) for r in chat_tree.read_back(chat_tree.build(table(spark, ROWS))).collect()}
    assert got == brute(ROWS)
    assert chat_tree.read_back(chat_tree.build(table(spark, []))).count() == 0


def test_a_long_conversation_is_one_segment(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(1500)] + [(2, 0, "user", "t0"), (2, 1, "assistant", "x")]
    tree = chat_tree.build(table(spark, rows))
    assert {len(r.path) for r in tree.leaves.collect()} == {2}
    assert tree.nodes.count() == 1501
    got = {r[0]: tuple(r[1:]) for r in chat_tree.read_back(tree).collect()}
    assert got == brute(rows)


def test_shared_turns_are_emitted_once_and_depth_first(spark):
    nodes = {r.node: r for r in chat_tree.build(table(spark, ROWS)).nodes.collect()}
    # hello; its answer; both third turns and a fourth; the empty answer; 5's two; the null
    # conversation's two; and role and text that only look alike.
    assert len(nodes) == 11
    order = sorted(nodes.values(), key=lambda r: r.emit_start)
    assert [r.emit_start for r in order] == [0, *[r.emit_end for r in order][:-1]]
    open_path = []
    for r in order:
        assert r.emit_end - r.emit_start == r.length == len(r.formatted)
        open_path = open_path[: r.turn_number - 1]
        assert len(open_path) == r.turn_number - 1
        assert r.position == sum(a.length for a in open_path)
        spans = [(a.emit_start, a.emit_end) for a in open_path]
        merged = []
        for a, b in spans:
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        assert [tuple(x) for x in r.attention] == merged
        open_path.append(r)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<s>[/INST]\\ a\n", max_size=12), st.text(alphabet="<s>[/INST]\\ a\né", max_size=30)), min_size=1, max_size=20))
def test_template_is_reversible(spark, turns):
    rows = spark.createDataFrame(turns, "role string, text string")
    whole = chat_tree.formatted(F.col("role"), F.col("text"))
    for r in rows.select("role", "text", *chat_tree.parsed(whole), whole.alias("f")).collect():
        assert (r[2], r[3]) == (r[0], r[1])
        assert all(r.f.count(c) == n for c, n in (("<s>", 1), ("</s>", 1), ("[INST]", 1), ("[/INST]", 1)))
