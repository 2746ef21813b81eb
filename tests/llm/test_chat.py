import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import chat

TEXT = st.text(alphabet=st.sampled_from("<|>nedtur/ \n[]a"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_templates_are_read_back(turns):
    text = "".join(f"{chat.OPEN}{chat.escape(r).replace(chr(10), chat.BREAK)}{chat.MIDDLE}{chat.escape(t)}{chat.CLOSE}" for r, t in turns)
    assert chat.parse(text) == turns


def test_text_outside_turns_is_refused():
    with pytest.raises(ValueError, match="outside"):
        chat.parse("<|turn|>user\nhi<|end|>x")


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"id": 4, "messages": [{"role": "user", "content": None}]}, [("user", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a", "system": "s"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a", "system": None}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "x", "output": "a"}, [("user", "i\nx"), ("assistant", "a")]),
    ({"instruction": "i", "output": "a"}, [("user", "i"), ("assistant", "a")]),
    ({"conv_id": 1, "turn": 0, "role": "human", "text": "x"}, [("human", "x")]),
]


@pytest.mark.parametrize("record, turns", RECORDS)
def test_layouts(record, turns):
    layout, got = chat.canonical(record)
    assert layout is not None and got == turns
    assert chat.canonical(record | {"surprise": 1}) == (None, [])


def test_layouts_of_a_table(spark):
    rows = [(i, 0, json.dumps(r), "x") for i, (r, _) in enumerate(RECORDS)] + [(90, 0, None, "x"), (91, 0, "not json", "x"), (92, None, "[1]", "x"), (93, 0, '{"other": 1}', "x")]
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string, part string")).collect()
    for i, (_, turns) in enumerate(RECORDS):
        assert [(r.role, r.text) for r in sorted((r for r in got if r.conv_id == i), key=lambda r: r.part)] == turns
    assert sorted(r.conv_id for r in got if r.layout is None) == [90, 91, 92, 93]


def test_unknown_records_make_no_turns(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    rows = [(1, 0, '{"foo": 1}'), (1, 1, "not json"), (1, 2, '{"prompt": "q", "completion": "a"}'), (1, 3, deep), (1, 4, '{"messages": []}'), (1, 5, '{"messages[]": [{"role": "user", "content": "x"}]}'), (2, 0, deep)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string"))
    assert sorted((r.conv_id, r.turn) for r in turns.where("part is null").collect()) == [(1, 0), (1, 1), (1, 3), (1, 4), (1, 5), (2, 0)]
    (got,) = chat.read_back(chat.formatted(turns)).collect()
    assert (got.conv_id, got.n_turns, got.loss_chars) == (1, 2, 1)


def test_paths_tell_keys_from_structure():
    paths = lambda x: sorted(chat.json_paths(x))
    assert paths({"a.b": 1}) != paths({"a": {"b": 1}}) and paths({"a[]": 1}) != paths({"a": [1]}) and paths({"a": {}}) != paths({})
    assert paths({"a": None}) == paths({}) and paths({"a": []}) == ["a"] == paths({"a": [None]})
    nested = {}
    for _ in range(50_000):
        nested = {"x": nested}
    assert len(paths(nested)) == 1
    assert chat.canonical({"prompt": "q", "completion": "a", "x": {}}) == (None, [])


def test_lone_surrogates_and_other_values(spark):
    rows = [(1, 0, '{"prompt": "\\ud800x", "completion": 5}'), (2, 0, '{"messages": [{"role": 1, "content": true}]}')]
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).orderBy("conv_id", "part").collect()
    assert [(r.role, r.text) for r in got] == [("user", "\ufffdx"), ("assistant", "5"), ("1", "True")]


def test_conversations_of_a_table(spark):
    rows = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", "é"), (1, 2, "assistant", None), (2, 0, None, "x" * 50_000), (2, 0, "a\nb", "<||"), (2, None, "system", "<|"), (None, 0, "assistant", "z"), (None, 0, "assistant", "z")]
    frame = spark.createDataFrame([(c, t, 0, r, x, "y") for c, t, r, x in rows], "conv_id long, turn long, part int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(frame)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got.keys() == {1, 2, None}
    assert got[1].turns_sha256 == sha("user\né\nassistant\nb<|end|>\nassistant\n\n") and got[1].n_turns == 3
    assert (got[1].loss_chars, got[1].loss_sha256) == (8, sha("b<|end|>"))
    assert got[1].formatted_chars == len("<|turn|>user\né<|end|><|turn|>assistant\nb<||end|><|end|><|turn|>assistant\n<|end|>")
    assert got[2].turns_sha256 == sha("system\n<|\n" + "\n" + "x" * 50_000 + "\na\nb\n<||\n") and got[2].loss_chars == 0
    assert got[None].loss_sha256 == sha("zz")
    assert chat.read_back(chat.formatted(frame.limit(0))).count() == 0
