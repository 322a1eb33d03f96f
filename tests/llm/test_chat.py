"""Chat formatting: whatever roles and texts say, the formatted text reads back as they are."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import chat

TEMPLATES = [chat.INSTRUCT, chat.MESSAGES]
BITS = st.sampled_from([*chat.INSTRUCT.controls, *chat.MESSAGES.controls, "\\", "<", "[", "]", ">", "/s>", "/INST]", "INST]", "<\\s>", "[\\/INST]", "[\\\\INST]", "<\\|im_end|>", "\n", " ", "a", "é", "𝄞"])
TEXTS = st.lists(BITS, max_size=12).map("".join)


@pytest.mark.parametrize("template", TEMPLATES)
@given(turns=st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
@settings(max_examples=300, deadline=None)
def test_round_trip(template, turns):
    made = [template.format(r, t) for r, t in turns]
    assert template.read("".join(x for x, _, _ in made)) == (turns, "")
    for (role, text), (x, a, z) in zip(turns, made):
        assert template.unescape(x[a:z]) == text
        assert not template.control.search(x[a:z])
        # texts without conflict stay as they are
        assert template.likeness.search(role + "\0" + text) or x == template.render(role, text)


@pytest.mark.parametrize("template", TEMPLATES)
@given(text=TEXTS)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(template, text):
    assert template.unescape(template.escape(text)) == text
    assert template.unescape(template.escape(template.escape(text))) == template.escape(text)


def test_malformed():
    for bad in ("[INST]user[/INST]a[INST]b</s>", "x[INST]user[/INST]a</s>", "[INST]user</s>", "</s>", "[INST]u[/INST]<s></s>"):
        with pytest.raises(chat.Malformed):
            chat.INSTRUCT.read(bad)
    assert chat.INSTRUCT.read("[INST]u[/INST]a</s>[INST]b") == ([("u", "a")], "[INST]b")
    for bad in (("<a>", "<a>", "b>"), ("abca", "xy", "zz"), ("<s", "s<", "yy"), ("\\a", "bc", "de"), ("a", "bc", "de")):
        with pytest.raises(ValueError):
            chat.Template(*bad)


def by_loop(rows):
    grouped: dict = {}
    for conv, turn, role, text, *_ in rows:
        form = chat.INSTRUCT.format(role or "", text or "")[0]
        grouped.setdefault(conv, []).append((turn is not None, turn or 0, form, role or "", text or ""))
    out = []
    for conv, turns in grouped.items():
        turns = sorted(turns)
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(f) for _, _, f, *_ in turns)))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, None, "system", "first é𝄞"), (2, 5, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "tie"),
    (2, 5, "assistant", "tie"), (None, 0, "assistant", "no id"), (None, 1, "tool</s>", "<\\s>"), (3, 0, "assistant", "long " * 50_000),
]


def test_query_against_loop(spark):
    turns = spark.createDataFrame([(*r, 5) for r in ROWS], "conv_id long, turn long, role string, text string, formatted int")
    got = sorted((tuple(x) for x in chat.read_back(chat.format_turns(turns)).collect()), key=str)
    assert got == by_loop(ROWS)
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert chat.read_back(chat.format_turns(empty)).collect() == []


def test_whole_texts(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for x in chat.conversation_texts(chat.format_turns(turns, chat.MESSAGES)).collect():
        rows = sorted((turn is not None, turn or 0, chat.MESSAGES.format(r or "", t or "")[0], r or "", t or "") for c, turn, r, t in ROWS if c == x["conv_id"])
        assert x["text"] == "".join(r[2] for r in rows)
        assert chat.MESSAGES.read(x["text"]) == ([r[3:] for r in rows], "")
        assert [chat.MESSAGES.unescape(x["text"][s["start"] : s["end"]]) for s in x["loss_spans"]] == [t for *_, r, t in rows if r == "assistant" and t]
