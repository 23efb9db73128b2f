import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import chat

ENCODING = chat.load_encoding(chat.VOCABULARY)
PART = st.sampled_from([*chat.CONTROL, "\\", " ", "\n", "é", "😀", "ok", "<", "/s>", "[INST"])
TEXT = st.lists(PART, max_size=8).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_escaping_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    for control in chat.CONTROL:
        at = escaped.find(control)
        while at >= 0:
            assert escaped[:at].endswith("\\")
            at = escaped.find(control, at + 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>", ""]), TEXT), max_size=5))
def test_round_trip_of_ids(turns):
    ids, mask = chat.assemble(turns, ENCODING)
    assert len(ids) == len(mask)
    assert chat.read_back(ids, ENCODING) == turns
    said = [t for r, t in turns if r == "assistant" and t]
    assert chat.learned_texts(ids, mask, ENCODING) == said


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXT), max_size=4))
def test_written_form_has_no_false_control(turns):
    """A control string that no backslash precedes is a real one."""
    whole = chat.written(chat.assemble(turns, ENCODING)[0], ENCODING)
    real = [c for c in ("<s>", "[ROLE]", "[/ROLE]", "</s>")]
    seen = sum(whole.startswith(c, i) and not whole[:i].endswith("\\")
               for c in real for i in range(len(whole)))
    assert seen == 4 * len(turns)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None),
            (2, 1, None, "x"), (2, None, "system", "first"), (None, 0, "assistant", "lost"),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"),
            (4, 0, "assistant", "long " * 50_000)]
    turns = chat.with_probe(spark.createDataFrame(
        [(*r, "extra") for r in rows],
        "conv_id bigint, turn bigint, role string, text string, ids string"))
    out = {r["conv_id"]: r for r in
           chat.digest_formatted(chat.format_conversations(turns)).collect()}

    def digest(*texts):
        return hashlib.sha256("".join(texts).encode()).hexdigest()

    assert out[1]["turns_sha256"] == digest("user\na\n", "assistant\nb\n")
    assert out[2]["turns_sha256"] == digest("system\nfirst\n", "user\n\n", "\nx\n")
    assert (out[2]["loss_chars"], out[2]["loss_sha256"]) == (0, digest(""))
    assert out[None]["loss_sha256"] == digest("lost")
    assert out[3]["n_turns"] == 2 and out[3]["loss_sha256"] == digest("samesame")
    assert out[4]["loss_chars"] == 250_000
    assert out[-1]["loss_sha256"] == digest("</s>[INST] ok [/INST]") and out[-1]["n_turns"] == 2
    assert all(0 <= r["loss_tokens"] < r["n_tokens"] for r in out.values())


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digest_formatted(chat.format_conversations(empty)).collect() == []
    assert chat.format_conversations(chat.with_probe(empty)).count() == 1
