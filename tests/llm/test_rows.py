"""What the corpus operators used to leave out."""

from collections import Counter

import duckdb

from attestra.llm import chat, decontaminate, neardup, queries

TALK = [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 2, "assistant", "x"), (1, 2, "assistant", "y"), (1, 9, "assistant", "lost"), (1, 9, "assistant", "too"), (1, 3, "tool", '{"k": "é"}'), (None, 1, "user", "no talk"), (2, None, "assistant", "no turn"), (2, 1, "user", None), (2, 5, None, None)]


def test_every_conversation_row_is_told(spark, tmp_path):
    spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.op6_chat_rows(spark, str(tmp_path)).collect()]
    assert Counter(r[3] for r in got) == {"call": 2, "further call": 2, "result": 1, "further result": 1, "orphan": 2, "other role": 3, "without key": 2}
    told = "".join(r[4] for r in got)
    assert all(text.replace('"', '\\"') in told for _, _, _, text in TALK if text)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert Counter(got) == Counter(con.sql(queries.SQL["op6_chat_rows"]).fetchall())


def test_arguments_that_are_no_json_stay(spark):
    calls = spark.createDataFrame([(1, "a", 1, "f", "no json", None), (1, None, 2, "f", "{}", None)], "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, None, 3, "r")], "conv_id long, call_id string, turn long, content string")
    got = {r["turn"]: (r["status"], r["message"]) for r in chat.every_row(calls, results).collect()}
    assert got == {1: ("call", '{"arguments":"no json","id":"a","name":"f"}'), 2: ("without key", '{"arguments":{},"name":"f"}'), 3: ("without key", '{"result":"r"}')}


def _text(word, n=30):
    return " ".join(f"{word}{i}" for i in range(n))


def _rows(df):
    return sorted(map(str, df.collect()))


def test_one_of_each_decides_for_rows(spark):
    rows = [(1, _text("a")), (None, _text("a") + " more"), (None, _text("b")), (None, _text("c")), (7, _text("d")), (7, _text("e")), (7, _text("a") + " less"), (7, _text("d")), (8, _text("f")), (8, _text("f") + " more"), (None, _text("g")), (None, _text("g")), (None, None), (None, ""), (7, None)]
    got = _rows(neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")))
    kept = [0, 2, 3, 4, 5, 10, 12, 13, 14]
    either = [_rows(spark.createDataFrame([rows[i] for i in [*kept, j]], "doc_id long, text string")) for j in (8, 9)]
    assert got in either


def test_decontaminate_decides_for_rows(spark):
    bad = _text("b", 20)
    rows = [(None, bad), (None, _text("c")), (None, None), (4, bad), (4, _text("d")), (5, _text("e"))]
    bench = spark.createDataFrame([(1, bad)], "item_id long, text string")
    got = _rows(decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench))
    assert got == _rows(spark.createDataFrame([rows[i] for i in (1, 2, 4, 5)], "doc_id long, text string"))
