"""Chat formatting: round trips, layouts, loss spans, and odd records."""

import json

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from steadycast.llm import chat, queries

CONTROL = ["### ", "</turn>\n", "\\", "\\b", "\\h##", "####", "###", "</turn></turn>", "a\\", "#" * 9, "", "ü😀 ### x: y", "\n"]


def test_texts_come_back(spark):
    rows = [(i, t, role, text) for i, role in enumerate(["user", "assistant", "### a: b", "", "x:\\c"]) for t, text in enumerate(CONTROL)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = turns.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    out = chat.format_turns(turns).select(
        "conv_id", "turns", chat.read_turns(F.col("formatted")).alias("back"), "formatted", "loss_spans",
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    for r in out.collect():
        assert r.turns == r.back
        assert r.formatted.count("</turn>\n") == len(r.turns)
        loss = [t.text for t in r.turns if t.role == "assistant"]
        assert r.loss == "".join(loss) and len(r.loss_spans) == len(loss)


def test_layouts_and_odd_records(spark):
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "exchanges", [("user", "q"), ("assistant", "r")]),
        ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
        ({"completion": "c", "prompt": "p"}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("system", "i"), ("user", "n"), ("assistant", "o")]),
        ({"output": "o", "instruction": "i"}, "bare_instruction", [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p"}, None, None),
        # Each item is mapped by its own fields; optional fields may stand beside those of a layout.
        ({"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"id": 7, "messages": [{"role": "user", "content": "a", "name": "x"}, {"content": "c", "role": "tool"}]}, "messages", [("user", "a"), ("tool", "c")]),
        ({"messages": []}, "messages", []),
        ({"messages": None}, None, None),
        # An item or a field without a mapping gives no turns at all.
        ({"messages": [{"role": "user", "content": "a"}, {"speaker": "x", "said": "y"}]}, None, None),
        ({"messages": [{"role": "user", "content": "a"}, "text"]}, None, None),
        ({"messages": [{"role": "user", "content": "a"}], "system": "s"}, None, None),
        # Texts that look like JSON are texts.
        ({"prompt": '{"a": [1]}', "response": '[{"b": 2}]'}, "prompt", [("user", '{"a": [1]}'), ("assistant", '[{"b": 2}]')]),
        ({"prompt": "p", "response": "\u00e9\n\"q\" 😀"}, "prompt", [("user", "p"), ("assistant", "\u00e9\n\"q\" 😀")]),
        ({"weird key's": {"a b": 1}}, None, None),
    ]
    rows = [(i, json.dumps(r), "clash") for i, (r, _, _) in enumerate(records)] + [(90, None, ""), (91, "not json", ""), (92, "[1]", "")]
    df = spark.createDataFrame(rows, "i int, record string, paths string")
    got = {r.i: r for r in chat.canonical_turns(df).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == turns
    assert all(got[i].turns is None and got[i].schema_fingerprint for i in (90, 91, 92))
    assert got[0].schema_fingerprint != got[1].schema_fingerprint


def test_fingerprint_reads_all_items(spark):
    lists = [[{"a": 1}], [{"a": 1}, {"a": 2}], [{"a": 1}, {"b": 2}], [{"b": 1}, {"a": {"c": 1}}], [{"a": 1}, 5], []]
    df = spark.createDataFrame([(i, json.dumps({"m": x, "o": {"p": 1}})) for i, x in enumerate(lists)], "i int, record string")
    got = {r.i: (r.p, r.f) for r in df.select("i", chat.field_paths(F.col("record")).alias("p"), chat.fingerprint(F.col("record")).alias("f")).collect()}
    assert got[0] == got[1] and got[2] == got[3] and len({f for _, f in got.values()}) == 4
    assert got[2][0] == ["m", "m[].a", "m[].b", "o", "o.p"] and got[4][0] == ["m", "m[]", "m[].a", "o", "o.p"] and got[5][0] == ["m", "o", "o.p"]


def test_very_long_text(spark):
    long = "x ### y" * 2_500_000
    df = spark.createDataFrame([(1, json.dumps({"prompt": long, "response": "r"}))], "i int, record string")
    (r,) = chat.canonical_turns(df).select(F.length(F.col("turns")[0]["text"]).alias("n")).collect()
    assert r.n == len(long)


def test_ties_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, record string"
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, 1, None, None, None)]
    out = chat.canonical_turns(chat.turn_rows(spark.createDataFrame(rows, schema)))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")]}
    assert chat.format_turns(chat.canonical_turns(chat.turn_rows(spark.createDataFrame([], schema)))).count() == 0


@pytest.mark.parametrize("name", ["op10_chat_formatting", "op3_mixing"])
def test_query_equals_its_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert difference(got, connect(sf_dir).execute(queries.ORACLES[name]).df()) is None


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.QUERIES["op10_chat_formatting"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
