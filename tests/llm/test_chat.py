import hashlib

import pytest
from pyspark.sql import functions as F

from railloom.llm import chat

NASTY = ["", "plain", "\\### Assistant: </turn> ok", "</turn>\n### user\nhi", "\\s\\l\\h\\n\\", "a\n\nb", "é漢\U0001f600", "\\\\l<#", "x" * 40_000 + "</turn>\n", " lead and trail "]


def roundtrip(spark, turns):
    df = spark.createDataFrame([(1, turns)], f"conv_id long, turns {chat.TURNS}")
    made = chat.format_turns(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss_text(F.col("formatted"), F.col("loss_mask")))
    return made.first()


def test_every_control_string_comes_back(spark):
    turns = [(role, text) for text in NASTY for role in ("user", "assistant", "odd <role>\n#\\", "")]
    got = roundtrip(spark, turns)
    assert [tuple(t) for t in got.back] == turns
    assert got.loss == [t for r, t in turns if r == "assistant"]
    assert got.formatted.count("</turn>\n") == len(turns) and got.formatted.count("### ") == len(turns)


def test_no_turns(spark):
    got = roundtrip(spark, [])
    assert got.formatted == "" and got.back == [] and got.loss == []


def test_rows_layout_with_nulls_ties_and_extra_columns(spark):
    rows = [(1, 1, "assistant", None, "q", 1), (1, 0, "user", "hi", "q", 1), (1, 0, None, "hi", "q", 1), (2, None, "user", "u", "q", 1), (None, 0, "assistant", "n", "q", 1), (1, 1, "assistant", None, "q", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, layout int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.canonical_turns(table))).collect()}
    want = {1: [("", "hi"), ("user", "hi"), ("assistant", ""), ("assistant", "")], 2: [("user", "u")], None: [("assistant", "n")]}
    assert set(got) == set(want)
    for key, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[key].n_turns, got[key].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), sha(loss))
    assert chat.canonical_turns(table.limit(0)).collect() == []


@pytest.mark.parametrize(
    "ddl, row, want",
    [
        ("conv_id long, messages array<struct<role: string, content: string, extra: int>>", (1, [("human", "q", 1), ("assistant", "a", 2), (None, None, 3)]), [("user", "q"), ("assistant", "a"), ("", "")]),
        ("conv_id long, conversations array<struct<from: string, value: string>>", (1, [("human", "q"), ("gpt", "a")]), [("user", "q"), ("assistant", "a")]),
        ("conv_id long, instruction string, input string, output string", (1, "do", "", "done"), [("user", "do"), ("assistant", "done")]),
        ("conv_id long, instruction string, input string, output string", (1, "do", "this", None), [("user", "do\n\nthis")]),
        ("conv_id long, prompt string, completion string, other int", (1, "p", "c", 4), [("user", "p"), ("assistant", "c")]),
        ("conv_id long, prompt struct<system: string, user: string>, response struct<text: string>", (1, ("s", "u"), ("r",)), [("system", "s"), ("user", "u"), ("assistant", "r")]),
        ("conv_id long, messages array<struct<role: string, content: string>>", (1, None), []),
    ],
)
def test_layouts(spark, ddl, row, want):
    got = chat.canonical_turns(spark.createDataFrame([row], ddl)).first()
    assert [tuple(t) for t in got.turns] == want


def test_unknown_layout_is_an_error(spark):
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, z int"))


def test_json_records_each_by_its_own_fingerprint(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'),
        (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"id":7}'),
        (3, '{"instruction":"i","input":"","output":"o"}'),
        (4, '{"prompt":"p","completion":"c"}'),
        (5, '{"prompt":{"system":"s","user":"u"},"response":{"text":"r"}}'),
        (6, '{"what":1}'), (7, None), (8, "no json"),
    ]
    got = {r.conv_id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical_turns_json(spark.createDataFrame(rows, "conv_id long, json string")).collect()}
    assert got[1] == ("messages", [("user", "q"), ("assistant", "a")])
    assert got[2] == ("message_turns", [("user", "q"), ("assistant", "a")])
    assert got[3] == ("instruction_input", [("user", "i"), ("assistant", "o")])
    assert got[4] == ("prompt_completion", [("user", "p"), ("assistant", "c")])
    assert got[5] == ("nested_prompt", [("system", "s"), ("user", "u"), ("assistant", "r")])
    assert got[6] == got[7] == got[8] == (None, None)
