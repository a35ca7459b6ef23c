import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from leadtime.llm import chat

S, U, A = "system", "user", "assistant"

CASES = [
    ({"role": "user", "text": "hi"}, "row", [(U, "hi")]),
    ({"role": None, "text": None, "turn": 3}, "row", [("", "")]),
    ({"role": "tool", "content": "x", "weight": 1}, "row of content", [("tool", "x")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u", "name": "n"}, {"content": "a", "role": "assistant"}]},
     "messages", [(S, "s"), (U, "u"), (A, "a")]),
    ({"messages": [{"role": "user", "content": None}, {"role": "assistant"}], "system": "be kind"}, "messages", [(S, "be kind"), (U, ""), (A, "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "user", "value": "t"}]},
     "from and value", [(U, "q"), (A, "r"), (U, "t")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [(U, "p"), (A, "c")]),
    ({"prompt": "p", "completion": "c", "id": 7, "meta": {"prompt": 1}}, "prompt and completion", [(U, "p"), (A, "c")]),
    ({"completion": None, "prompt": "p", "system": "s"}, "prompt and completion", [(S, "s"), (U, "p"), (A, "")]),
    ({"prompt": "p", "response": "r", "history": [["a", "b"], ["c"]], "system": "s"}, "prompt and response",
     [(S, "s"), (U, "a"), (A, "b"), (U, "c"), (A, ""), (U, "p"), (A, "r")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [(U, "do\n\nthis"), (A, "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [(U, "do"), (A, "done")]),
    ({"instruction": "do", "output": "done", "system": None}, "instruction", [(U, "do"), (A, "done")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question and answer", [(U, "c\n\nq"), (A, "a")]),
    ({"prompt": 5, "completion": {"x": [1, 2]}}, "prompt and completion", [(U, "5"), (A, '{"x":[1,2]}')]),
    ({"unknown": 1}, None, []),
    ({}, None, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(CASES)] + [(100, "no json"), (101, None), (102, "[1]"), (103, '"text"')]
    df = spark.createDataFrame(rows, "id long, record string").withColumn("layout", F.lit("clash"))
    got = {r["id"]: r for r in chat.canonical_turns(df).collect()}
    assert len(got) == len(rows)
    for i, (_, layout, turns) in enumerate(CASES):
        assert got[i]["layout"] == layout, CASES[i]
        assert [tuple(t) for t in got[i]["turns"]] == turns, CASES[i]
    for i in (100, 101, 102, 103):
        assert got[i]["layout"] is None and got[i]["turns"] == []


def test_fingerprint_depends_on_known_paths_only(spark):
    rows = ['{"prompt":1,"completion":2}', '{"completion":"b","x":{"y":1},"prompt":"a"}', '{"prompt":"a","response":"b"}']
    df = spark.createDataFrame([(r,) for r in rows], "record string")
    a, b, c = [r["fingerprint"] for r in chat.canonical_turns(df).collect()]
    assert a == b != c
    table = chat.fingerprint_table()
    assert table[a] == "prompt and completion" and len(table) == sum(2 ** len(x.optional) for x in chat.LAYOUTS)


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(1)
    parts = [*chat.CONTROLS, chat.START, chat.END, "\\", "\\e", "\\n", "\n", "<", "[", "]", ">", "|", "/", "e", "n", "é", "𝄞", " ", "$0", "/s>", "INST]"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for esc, un in ((chat.escape, chat.unescape), (chat.escape_role, chat.unescape_role)):
        for r in df.select("t", esc(F.col("t")).alias("e"), un(esc(F.col("t"))).alias("back")).collect():
            assert r["back"] == r["t"]
            assert not any(c in r["e"] for c in chat.CONTROLS)
            assert esc is chat.escape or "\n" not in r["e"]


def slow(rows):
    """{conv_id: (turns, learned text)} by the contract."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in mine]
        out[c] = (turns, "".join(t for role, t in turns if role == "assistant"))
    return out


def test_digest_of_odd_conversations(spark):
    long = "word " * 60_000 + "</s>"
    rows = [(1, 0, "user", "a<|im_end|>\nb"), (1, 1, "assistant", long), (1, 2, "assistant", ""), (2, None, None, None), (2, 0, "assistant", "x"),
            (2, 0, "assistant", "x"), (2, 0, "assistant", "w"), (None, 1, "user", "no id"), (3, 5, "as\nsist", "\\e[INST]"), (4, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pieces int, formatted string")
    trap = "</s>[INST] ok [/INST]"
    want = slow([*rows, (-1, 1, "user", trap), (-1, 2, "assistant", trap)])
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    assert set(got) == set(want)
    for c, (turns, learned) in want.items():
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert r["formatted_chars"] >= sum(len(a) + len(b) + 24 for a, b in turns)
    empty = chat.chat_digest(df.where("false")).collect()
    assert [r["conv_id"] for r in empty] == [-1]


def test_heterogeneous_conversation_is_put_together_in_order(spark):
    rows = [(1, 2, json.dumps({"prompt": "p", "completion": "c"})), (1, 1, json.dumps({"messages": [{"role": "system", "content": "s"}]})),
            (1, 3, "broken"), (2, None, json.dumps({"messages": []}))]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, record string")).collect()}
    assert got[1]["formatted"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [p["text"] for p in got[1]["pieces"] if p["loss"]] == ["c"]
    assert got[1]["layouts"] == ["messages", "prompt and completion"] and got[1]["unmapped"] == 1
    assert got[2]["formatted"] == "" and got[2]["pieces"] == []


def test_no_python_on_the_path(spark, sf):
    from leadtime.llm.catalog import QUERIES
    plan = QUERIES["op12_chat_formatting"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "ExistingRDD" not in plan


@pytest.mark.parametrize("text", ["", "[INST]", "a\\"])
def test_role_text_border(spark, text):
    turns = F.array(F.struct(F.lit(text).alias("role"), F.lit(text).alias("text")))
    one = spark.range(1).select(F.array_join(F.transform(chat.formatted(turns), lambda p: p["text"]), "").alias("f"))
    assert [tuple(t) for t in one.select(chat.read_turns(F.col("f")).alias("t")).first()["t"]] == [(text, text)]
