"""Topological levels of tool calls against brute force."""

import random

from attestra.llm import chat

EDGES = "conv_id long, call_id string, dep string"


def brute_levels(edges):
    deps = {}
    for conv, call, dep in edges:
        deps.setdefault((conv, call), set()).add((conv, dep))
    level = {d: 0 for ds in deps.values() for d in ds if d not in deps}
    while ready := [c for c, ds in deps.items() if c not in level and all(d in level for d in ds)]:
        level |= {c: 1 + max(level[d] for d in deps[c]) for c in ready}
    return {c: level.get(c) for c in deps}


def levels(spark, edges):
    rows = chat.topological_levels(spark.createDataFrame(edges, EDGES)).collect()
    assert len(rows) == len({(r["conv_id"], r["call_id"]) for r in rows})
    return {(r["conv_id"], r["call_id"]): r["level"] for r in rows}


def test_random_graphs_with_cycles(spark):
    rng = random.Random(5)
    edges = []
    for conv in range(60):
        n = rng.randint(2, 12)
        for i in range(1, n):
            edges += [(conv, f"c{i}", f"c{rng.randrange(i)}") for _ in range(rng.choice([1, 1, 1, 2, 3]))]
        if conv % 4 == 0:
            edges.append((conv, f"c{rng.randrange(n)}", f"c{rng.randrange(n)}"))
    want = brute_levels(edges)
    assert None in want.values() and max(v or 0 for v in want.values()) > 4
    assert levels(spark, edges) == want


def test_a_conversation_of_thousands_of_turns_takes_a_round_a_digit(spark, monkeypatch):
    written = []
    monkeypatch.setattr(chat, "stored", lambda df, real=chat.stored: written.append(1) or real(df))
    edges = [(1, f"c{i}", f"c{i - 1}") for i in range(1, 5001)] + [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "d", "a"), (3, "x", "x")]
    got = levels(spark, edges)
    assert all(got[1, f"c{i}"] == i for i in range(1, 5001))
    assert {c: v for c, v in got.items() if c[0] > 1} == {(2, "a"): None, (2, "b"): None, (2, "c"): None, (2, "d"): None, (3, "x"): None}
    assert len(written) < 25


def test_no_edges(spark):
    assert levels(spark, []) == {}


def test_calls_with_clashing_columns_nulls_and_long_texts(spark):
    long = "word " * 50_000
    rows = [(1, 0, "user", long, 7, "x"), (1, 1, "assistant", long, 8, "y"), (1, 2, "user", "", 9, None), (None, 0, "user", "a", 1, None), (1, None, "user", "a", 1, None), (1, 2, None, "a", 1, None)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id long, level string")
    calls, results = chat.calls_of(talk)
    got = {r["call_id"]: r for r in chat.link_tool_calls(calls, results, chat.reply_schema(spark)).collect()}
    assert {c: (r["status"], r["level"], r["valid"]) for c, r in got.items()} == {"t0": ("linked", 0, True), "t2": ("unanswered", 1, True)}
    assert got["t0"]["message"] == '{"arguments":{"text":"' + long + '","turn":0},"id":"t0","name":"reply","result":"' + long + '"}'
