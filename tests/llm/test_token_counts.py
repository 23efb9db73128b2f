import numpy as np
import pytest

from gleanery.llm import token_counts as tc

ENCODING, LENGTHS = tc.load_encoding(tc.VOCABULARY)


def brute(fields, by_line, rule):
    """Sections and tokens of a document, character by character."""
    text, sections = "", []
    for i, (name, value) in enumerate(fields):
        value += " " if i + 1 < len(fields) else ""
        parts = [p + "\n" for p in value.split("\n")] if name in by_line else [value]
        if name in by_line:
            parts[-1] = parts[-1][:-1]
            if len(parts) > 1 and not parts[-1]:
                parts.pop()
        for k, part in enumerate(parts):
            sections.append([name, k, len(text), len(text) + len(part), 0, 0])
            text += part
    raw_at, owner = 0, []
    for k, s in enumerate(sections):
        owner += [k] * len(text[s[2]:s[3]].encode())
    ids = ENCODING.encode_ordinary(text)
    for token in ids:
        size = len(ENCODING.decode_single_token_bytes(token))
        mine = owner[raw_at:raw_at + size]
        best = mine[0] if rule == "first" else max(sorted(set(mine)), key=mine.count)
        sections[best][4] += 1
        sections[best][5] += len(set(mine)) > 1
        raw_at += size
    return [(*s, len(ids)) for s in sections]


ROWS = [(1, "Plain text.\nTwo lines\n\n\nmore", "en", "src1"), (2, None, None, None), (3, "", "de", "s"),
        (4, "é😀 ñandú\n\n日本語 text", "fr", None), (5, "\n\n \n  x\n", "es", "src9"),
        (None, "no id", "en", "a b"), (7, "word " * 40_000 + "\n" + "x" * 50_000, "en", "s")]


@pytest.mark.parametrize("rule", tc.RULES)
def test_against_brute_force(documents, rule):
    found = {}
    frame = documents([(*r, "x") for r in ROWS], ", field string")
    for r in tc.section_tokens(frame, rule=rule).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r[1:]))
    for doc_id, text, lang, source in ROWS:
        expected = brute([("source", source or ""), ("lang", lang or ""), ("text", text or "")],
                         ("text",), rule)
        assert sorted(found[doc_id]) == sorted(expected), doc_id


def test_boundary_tokens_follow_the_rule():
    starts, ends = np.array([0, 4, 10]), np.array([4, 10, 12])
    for rule, expected in (("first", [0, 0, 2]), ("most", [0, 1, 2])):
        own, crossing = tc.allocate(starts, ends, np.array([0, 5, 10]), 12, rule)
        assert own.tolist() == expected and crossing.tolist() == [False, True, False]
    # Equal shares: the earlier section.
    assert tc.allocate(np.array([2]), np.array([6]), np.array([0, 4]), 8, "most")[0].tolist() == [0]


def test_sections_add_up_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    totals = {}
    for r in tc.section_tokens(docs).collect():
        totals.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["n_tokens"]
    assert all(a == b for a, b in totals.values())
    for r in docs.collect():
        whole = f"{r['source']} {r['lang']} {r['text']}"
        assert totals[r["doc_id"]][1] == len(ENCODING.encode_ordinary(whole))


def test_empty_and_repeats(documents):
    assert tc.section_tokens(documents([])).collect() == []
    assert tc.section_tokens(documents([ROWS[0]] * 2)).count() == 2 * len(
        brute([("source", "src1"), ("lang", "en"), ("text", ROWS[0][1])], ("text",), "most"))
    with pytest.raises(ValueError):
        tc.section_tokens(documents([]), rule="half")
