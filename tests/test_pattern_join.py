"""Definitions as a table give the pairs that definitions as literals give."""

import random

import pytest

from gleanery.functions import regex
from gleanery.operators import pattern_join
from gleanery.operators.pattern_join import join_patterns
from gleanery.operators.search import matching_definitions
from gleanery.plans.table import prepare_table


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(2)
    words = ["licence", "LICENSE", "password", "track(12)", "track(7)", "été", "K", "ſecret", "foo"]
    rows = [(i, rng.choice([None, "http://x/a", "foo.org"]),
             " ".join(rng.choice(words) for _ in range(rng.randrange(8)))) for i in range(80)]
    rows += [(100, None, None), (101, "licence", None), (102, "", ""), (103, None, "x" * 2_000_000 + "licence")]
    rows += [(7, "foo", "password twice")] * 2
    frame = spark.createDataFrame(rows, "id bigint, name string, text string").repartition(3)
    return prepare_table(frame, ["id"], "name", "text")


DEFINITIONS = {
    "licence": "licen[cs]e", "secret": "secret|password", "call": r"track[(]1[0-9][)]",
    "short": "k", "none": "[0-9]{2}", "any": "", "start": "^foo", "two": "track.*foo",
    "either": "zzzzzz|été", "long": "track[(]7[)]"}


def pairs(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("chunk, small", [(500, 200_000), (2, 0)])
def test_equal_to_literals(spark, records, monkeypatch, chunk, small):
    monkeypatch.setattr(pattern_join, "CHUNK", chunk)
    monkeypatch.setattr(pattern_join, "MAX_BROADCAST", small)
    table = spark.createDataFrame(list(DEFINITIONS.items()) + [("bad", "[x"), ("null", None)],
                                  "definition string, pattern string")
    assert pairs(join_patterns(records, ["id"], table)) == \
        pairs(matching_definitions(records, ["id"], DEFINITIONS))


def test_patterns_of_one_name_are_one_definition(spark, records):
    table = spark.createDataFrame([("a", "licence"), ("a", "password"), ("a", "licence")],
                                  "definition string, pattern string")
    expected = matching_definitions(records, ["id"], {"a": "licence|password"})
    assert pairs(join_patterns(records, ["id"], table)) == pairs(expected)


def test_no_definitions_no_records(spark, records):
    empty = spark.createDataFrame([], "definition string, pattern string")
    assert pairs(join_patterns(records, ["id"], empty)) == []
    some = spark.createDataFrame([("a", "licence")], "definition string, pattern string")
    assert pairs(join_patterns(records.limit(0), ["id"], some)) == []


def test_ten_thousand_definitions_join_on_grams(spark):
    """No nested loop, and no more candidates than share a rare gram."""
    table = spark.range(10_000).selectExpr(
        "concat('d', id) as definition", "concat('track[(]', id, '[)]') as pattern")
    frame = spark.range(300).selectExpr("id", "'n' as name", "concat('a track(', id * 37, ') b') as text")
    found = join_patterns(prepare_table(frame, ["id"], "name", "text"), ["id"], table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs(found) == sorted((i, f"d{i * 37}") for i in range(300) if i * 37 < 10_000)


def test_grams_of_all_places():
    import numpy as np
    data = np.frombuffer(b"abcdefg", np.uint8)
    assert len(pattern_join._grams(data, 6)) == 2 and len(pattern_join._grams(data[:2], 3)) == 0
    assert not set(pattern_join._grams(data, 6)) & set(pattern_join._grams(data, 3))
    assert regex.required_literals("licen[cs]e") == ("licen",)


def test_long_numbers_share_no_gram(spark):
    """Of a call with seven digits, the grams that are indexed are its own, and a row of
    candidates has all of a record; the patterns are parsed by many tasks."""
    table = spark.range(1_000_000, 1_004_000).selectExpr(
        "concat('d', id) as definition", "concat('track[(]', id, '[)]') as pattern")
    batch, = pattern_join._indexed(table.toArrow().to_batches(max_chunksize=10_000)[:1])
    held = {}
    for definition, gram in zip(batch["definition"].to_pylist(), batch["gram"].to_pylist()):
        held.setdefault(gram, set()).add(definition)
    fewest = {d: min(len(held[g]) for g, ds in held.items() if d in ds)
              for d in batch["definition"].to_pylist()[:300:100]}
    assert set(fewest.values()) == {1}
    frame = spark.range(50).selectExpr(
        "id", "'n' as name", "concat('track(', 1000000 + id, ') TRACK(', 1000100 + id, ')') as text")
    found = pairs(join_patterns(prepare_table(frame, ["id"], "name", "text"), ["id"], table))
    assert found == sorted((i, f"d{1000000 + i + more}") for i in range(50) for more in (0, 100))


def test_odd_characters_join_on_grams(spark):
    """Characters that match ASCII ones are no reason to try every definition."""
    table = spark.createDataFrame([(f"d{i}", f"kiss{i:04}") for i in range(2000)],
                                  "definition string, pattern string")
    frame = spark.createDataFrame([(1, "K\u0130\u017fs0007"), (2, "k\u0131\u017f\u017f1999 \u0130"),
                                   (3, "\u0130\u0131"), (4, "\u212a\u0131\u017f\u017f0012")], "id int, text string") \
        .selectExpr("id", "'n' as name", "text")
    found = pairs(join_patterns(prepare_table(frame, ["id"], "name", "text"), ["id"], table))
    assert found == [(1, "d7"), (2, "d1999"), (4, "d12")]
    grams = pattern_join._map(spark, spark.createDataFrame([(1,)], "gram bigint"), 1)
    import pyarrow as pa
    rows = pa.RecordBatch.from_pydict({"mark": [b"m"], "name": [None], "text": ["\u0130\u017f"]},
                                      schema=pa.schema([("mark", pa.binary()), ("name", pa.string()),
                                                        ("text", pa.string())]))
    assert next(pattern_join._found(grams)([rows])).num_rows == 0
