import hashlib
import json
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from marginalia.llm import chat
from marginalia.llm.queries import op7_chat

TEXTS = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "\n", "<", "/s>", "[", "INST]", "é", " "]), st.text(max_size=3)), max_size=8).map("".join)


@given(TEXTS)
def test_escape_round_trip(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXTS), TEXTS), max_size=5))
def test_turns_round_trip(turns):
    text, mask = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert chat.masked(text, mask) == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "user", "value": "q"}, {"from": "assistant", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"response": "a", "prompt": "q"},
        {"data": {"instruction": "q", "output": "a"}},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, '{"other": 1}'), (91, "not json"), (92, None), (93, '{"messages": []}'), (94, '{"instruction": "s", "input": null, "output": "o"}')]
    out = {r["id"]: r for r in chat.format_records(spark.createDataFrame(rows, "id long, record string"), ["id"]).collect()}
    for i in range(len(records)):
        assert chat.parsed(out[i]["formatted"]) == want and out[i]["error"] is None
    assert len({out[i]["layout"] for i in range(5)}) == 4  # the order of fields doesn't matter
    assert [out[i]["error"] for i in (90, 91, 92, 93)] == ["unknown layout", "not JSON", "not JSON", None]
    assert out[93]["formatted"] == "" and chat.parsed(out[94]["formatted"]) == [("system", "s"), ("user", ""), ("assistant", "o")]


def test_values_and_fields_that_are_no_texts(spark):
    records = [
        {"prompt": 0, "response": False},
        {"prompt": "q", "response": "a", "id": 7, "meta": {"x": [1]}},
        {"system": "s", "prompt": "q", "response": None},
        {"instruction": "q", "output": "a", "source": "x"},
        {"messages": [{"role": "user", "content": 1.5, "id": "m1"}]},
        {"prompt": "q", "response": "a", "more": "b"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    out = {r["id"]: r for r in chat.format_records(spark.createDataFrame(rows, "id long, record string"), ["id"]).collect()}
    turns = [chat.parsed(out[i]["formatted"]) for i in range(5)]
    assert turns == [[("user", "0"), ("assistant", "false")], [("user", "q"), ("assistant", "a")], [("system", "s"), ("user", "q"), ("assistant", "")], [("user", "q"), ("assistant", "a")], [("user", "1.5")]]
    assert out[5]["error"] == "unknown layout" and out[5]["formatted"] is None


def plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        body = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        size = sum(8 + len(chat.escape(r)) + len(chat.escape(t)) for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same = "</s>[INST] ok [/INST]"
    want = plain([*rows, (-1, 0, "user", same), (-1, 1, "assistant", same)])
    got = {r["conv_id"]: tuple(r)[1:] for r in op7_chat(spark, sf_dir).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "a"), (None, None, "assistant", "b"), (2, 0, "user", "long " * 50_000), (3, 0, "assistant", ""), (4, 0, "a\nb", "t")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_records(chat.conversation_records(table), ["conv_id"]), ["conv_id"]).collect()}
    for conv, want in plain(rows).items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want[:4]
    assert chat.conversation_records(table.limit(0)).count() == 0
