"""op10: layouts, the template and its inverse, the query against plain Python."""
import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.llm import chat

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, id int, record string, t int"


def turns_of(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, record string")
    rows = {r.id: r for r in chat.format_records(df).collect()}
    return [None if rows[i].turns is None else [(t.role, t.text) for t in rows[i].turns] for i in range(len(records))]


def test_layouts(spark):
    u, a = ("user", "q"), ("assistant", "r")
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, [u, a]),
        ({"messages": [{"role": "user", "content": "q", "weight": 1}], "source": "x", "id": 3}, [u]),
        ({"messages": [{"content": None, "role": None}]}, [("", "")]),
        ({"messages": []}, []),
        ({"turns": [{"role": "Human", "text": "q"}, {"role": "bot", "text": "r"}]}, [u, a]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [u, a]),
        ({"instruction": "q", "output": "r"}, [u, a]),
        ({"instruction": "q", "input": "more", "output": "r"}, [u, ("user", "more"), a]),
        ({"output": "r", "input": "", "instruction": "q"}, [u, a]),
        ({"prompt": "q", "completion": "r"}, [u, a]),
        ({"prompt": "q", "response": "r", "meta": {"role": "x"}}, [u, a]),
        ({"system": "s", "prompt": "q", "response": "r"}, [("system", "s"), u, a]),
        ({"question": "q", "answer": None}, [u, ("assistant", "")]),
        ({"unheard": "of"}, None),
        ({}, None),
    ]
    got = turns_of(spark, [json.dumps(c) for c, _ in cases] + [None, "no json", "[1]", '"text"'])
    assert got == [t for _, t in cases] + [None] * 4


TEXTS = ["", "\\", "\\\\", "<", ">", "\\l", "\\b", "</turn>\n", "<turn user>", "\\### Assistant: </turn> ok", "é😀\n\t\x00", "a" * 70000, "\\bl\\g<b>"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>b", "<\\"]), st.text(alphabet="\\<>lbg/turn \n", max_size=12)), max_size=5))
def test_template_is_reversible(spark, turns):
    check(spark, turns)


def check(spark, turns):
    df = spark.createDataFrame([([{"role": r, "text": t} for r, t in turns],)], f"turns {chat.TURNS}")
    out = df.select(chat.formatted_text(F.col("turns")).alias("f"), chat.loss_mask(F.col("turns")).alias("m"))
    row = out.select("f", "m", chat.parse(F.col("f")).alias("back"), chat.masked(chat.lines_of(F.col("f")), F.col("m")).alias("loss")).first()
    assert [(t.role, t.text) for t in row.back] == list(turns)
    assert row.loss == "".join(t for r, t in turns if r == "assistant")
    lines = row.f.split("</turn>\n")  # the places hold in the output itself
    cut = [lines[m.turn][m.start:m.end] for m in row.m]
    assert [c.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\") for c in cut] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("text", TEXTS)
def test_hard_texts(spark, text):
    check(spark, [("user", text), ("assistant", text), ("system", text)])


def test_query(spark):
    rows = [(1, 1, "assistant", "b</turn>", 0, "x", 1), (1, 0, "user", "a", 0, "x", 1), (2, 0, "user", None, 0, "x", 1),
            (3, 0, "assistant", "tie", 0, "x", 1), (3, 0, "assistant", "tie", 0, "x", 1), (4, 0, None, "no role", 0, "x", 1),
            (None, 0, "user", "no id", 0, "x", 1), (5, None, "user", "first", 0, "x", 1), (5, 0, "assistant", TEXTS[-2], 0, "x", 1)]
    docs = spark.createDataFrame(rows, CONVERSATIONS)
    marker = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    by = {}
    for i, n, r, t, *_ in [*rows, *marker]:
        by.setdefault(i, []).append(((n is not None, n or 0), r or "", t or ""))
    want = {}
    for i, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        size = sum(len("<turn ></turn>\n") + sum(len(x) + sum(x.count(c) for c in "\\<>") for x in (r, t)) for _, r, t in turns)
        want[i] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss),
                   hashlib.sha256(loss.encode()).hexdigest(), size)
    assert {r.conv_id: tuple(r)[1:] for r in chat.op10(spark, docs).collect()} == want
    assert [r.conv_id for r in chat.op10(spark, docs.where("conv_id > 99")).collect()] == [-7]


def test_no_python_in_the_plan(spark):
    plan = chat.op10(spark, spark.createDataFrame([], CONVERSATIONS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_records_come_in_several_layouts(spark):
    rows = spark.range(60).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    got = chat.records_of(rows).select("id", "record", chat.fingerprint(chat.field_paths(F.col("record"))).alias("p"),
                                       chat.canonical(F.col("record")).alias("t")).collect()
    assert len({r.p for r in got}) == 3 and all([(t.role, t.text) for t in r.t] == [("user", "hi")] for r in got)


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert [r.conv_id for r in chat.op10(spark, none).collect()] == [-7]
