"""Chat formatting: round trip, loss spans, the machine, and edge cases.  The query has a SQL oracle besides."""

import random

import pytest

from oremill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments int, formatted string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}


def test_round_trip_of_control_strings(spark):
    rng = random.Random(2)
    bits = ["<|turn|>", "<|end|>\n", "<|", "&lt;|", "&amp;", "&", "\n", "&#10;", "assistant", "<", "|>", "\\", "$1", " ", "é"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(200)]
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "system", "a<|end|>\nb&"]), t) for i, t in enumerate(texts)]
    got = run(spark, rows)
    for c in got:
        mine = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2], r[3]) for r in mine]
        assert list(got[c].loss_texts) == [r[3] for r in mine if r[2] == "assistant"]
        assert got[c].formatted.count("<|turn|>") == len(mine)
        assert "".join(s.text for s in got[c].segments) == got[c].formatted


def test_machine_and_edges(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "user", "u"), (3, 0, "assistant", "a"), (4, 1, "assistant", "late"), (4, 0, "user", "early"),
        (None, None, None, None), (None, 1, "user", ""), (5, 0, "user", "x" * 300_000), (6, 0, "user", "b"), (6, 0, "user", "a"), (6, 0, "user", "a"),
    ]
    got = run(spark, rows)
    assert (got[1].first_bad_turn, got[1].open_ended) == (None, False)
    assert (got[2].first_bad_turn, got[2].open_ended) == (1, True)
    assert got[3].first_bad_turn == 0
    assert [t.text for t in got[4].turns] == ["early", "late"] and got[4].first_bad_turn is None
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("user", "")]
    assert len(got[5].turns[0].text) == 300_000
    assert [t.text for t in got[6].turns] == ["a", "a", "b"]
    assert run(spark, []) == {}


def test_other_template(spark):
    t = chat.Template(turn_mark="<|im|>", role_end="\n", end_mark="<|stop|>", trained=("user",))
    df = spark.createDataFrame([(1, 0, "user", "say <|stop|>")], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_chats(df, t), t).first()
    assert r.turns[0].text == "say <|stop|>" and list(r.loss_texts) == ["say <|stop|>"]


def test_escapes_follow_the_template(spark):
    t = chat.Template(turn_mark="### ", end_mark="</turn>")
    texts = ["say </turn> ok", "### ", "#", "</turn", "&60;/turn>", chat.PROBE, "&", "&38;35;"]
    rows = [(1, i, "assistant" if i % 2 else "us#er</turn>\n", x) for i, x in enumerate(texts)]
    r = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t), t).first()
    assert [(x.role, x.text) for x in r.turns] == [(row[2], row[3]) for row in rows]
    assert list(r.loss_texts) == texts[1::2] and r.formatted.count("</turn>") == len(rows)


@pytest.mark.parametrize("marks", [{"turn_mark": ""}, {"end_mark": "&end"}, {"end_mark": "1"}, {"turn_mark": "x</", "end_mark": "</turn>"}])
def test_marks_that_cannot_be_told_apart_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Template(**marks)
