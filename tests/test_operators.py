"""Operators on small fixtures, against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.operators import export, matches, search, summary
from gleanery.plans.table import search_table
from gleanery.sinks import report
from gleanery.sources.definitions import load_definitions, require_valid

MATCHES = ["4711", "0815", "4711", "4711", "2001", "0815"]


def pairs_of(spark, name_matches, content_matches):
    return spark.createDataFrame(
        [(1, "n", "d", name_matches, content_matches)],
        "k int, name string, definition string, name_matches array<string>,"
        " content_matches array<string>")


def test_counts_and_numbering(spark):
    pairs = pairs_of(spark, [], MATCHES)
    row = matches.match_counts(pairs).collect()
    assert [(r.scope, r.total, r.unique, r.duplicates) for r in row] == [
        ("file contents", 6, ["4711", "0815", "2001"], 3)]
    items = matches.match_items(pairs).orderBy("item").collect()
    assert [(r.item, r.match) for r in items] == [(1, "4711"), (2, "0815"), (3, "2001")]
    case = matches.match_counts(pairs_of(spark, ["Foo", "foo"], [])).first()
    assert (case.scope, case.total, case.duplicates) == ("file name", 2, 0)
    assert matches.match_counts(pairs_of(spark, [], [])).count() == 0


def test_record_block(spark):
    block = pairs_of(spark, ["a"], MATCHES).select(report.record_block(
        F.lit("x.gz"), F.col("name"), F.col("name_matches"), F.col("content_matches"))
        .alias("b")).first().b
    assert block == (
        "[Archive: x.gz]\n[File: n]\n\n"
        "[Matches found in file name: 1 (0 duplicates omitted)]\n"
        '[Match #1 in file name]\n\n"a"\n\n'
        "[Matches found in file contents: 6 (3 duplicates omitted)]\n"
        '[Match #1 in file contents]\n\n"4711"\n\n[Match #2 in file contents]\n\n"0815"\n\n'
        '[Match #3 in file contents]\n\n"2001"\n\n' + "_" * 67 + "\n\n")


@pytest.mark.parametrize("dialect", ["native", "python", "auto"])
@pytest.mark.parametrize("search_binary", [False, True])
def test_search_equals_loop(spark, dialect, search_binary):
    rng = random.Random(3)
    rows = [(i, rng.choice(["http://foo/1", "http://bar", "", None]),
             bytes(rng.choice(b"foba 12\n\x00\xff") for _ in range(rng.randrange(40))))
            for i in range(300)]
    rows.append((300, "late", b"x" * 1024 + b"\x00foo"))
    definitions = {"foo": "fo+", "two": "[0-9]{2}", "either": "oo|bb", "text": "ba?b"}
    df = spark.createDataFrame(rows, "k int, name string, payload binary")
    found = search_table(df, ["k"], "name", "payload", definitions, is_text=False,
                         search_binary=search_binary, dialect=dialect)
    binary = re.compile(rb"[\x00-\x06\x0b\x0e-\x1a\x1c-\x1f\x7f]")
    expected = set()
    for k, name, payload in rows:
        for d, p in definitions.items():
            rx = re.compile(p, re.IGNORECASE)
            in_name = rx.findall(name or "")
            searched = search_binary or not binary.search(payload[:1024])
            in_text = rx.findall(payload.decode("utf-8", "ignore")) if searched else []
            if in_name or in_text:
                expected.add((k, d, tuple(in_name), tuple(in_text)))
    assert {(r.k, r.definition, tuple(r.name_matches), tuple(r.content_matches))
            for r in found.collect()} == expected
    prepared = search.prepare(df, ["k"], F.col("name"), F.col("payload"),
                              search_binary=search_binary)
    pairs = search.matching_definitions(prepared, ["k"], definitions, dialect).collect()
    assert sorted((r.k, r.definition) for r in pairs) == sorted(e[:2] for e in expected)
    kept = search.records_with_a_match(prepared, definitions, dialect).collect()
    assert sorted(r.k for r in kept) == sorted({e[0] for e in expected})
    records = search.search_records(prepared, definitions, dialect) \
        .select("k", F.inline("hits")).collect()
    assert {(r.k, r.definition) for r in records} == {e[:2] for e in expected}


def test_many_definitions(spark):
    """Hundreds of definitions in one pass, some matching the empty string."""
    definitions = {f"d{i}": f"w{i}(?![0-9])" for i in range(600)} | {"any": ""}
    df = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(300)], "k int, t string")
    found = search_table(df, ["k"], F.lit(None).cast("string"), "t", definitions)
    assert found.where("definition <> 'any'").count() == 600
    assert found.where("definition = 'any'").count() == 300


def test_first_per_entry_with_a_hot_entry(spark):
    rng = random.Random(4)
    rows = [("d", "hot" if rng.random() < 0.5 else f"e{rng.randrange(50)}",
             f"a{rng.randrange(5)}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "definition string, entry_name string, a string, i int")
    first = {}
    for d, e, a, i in rows:
        first[e] = min(first.get(e, (a, i)), (a, i))
    got = export.first_per_entry(df.repartition(8), ["a", "i"]).collect()
    assert {r.entry_name: (r.a, r.i) for r in got} == first


def test_merge_exports(spark):
    def part(*entries):
        return spark.createDataFrame([("d", *e) for e in entries], (
            "definition string, entry_name string, payload string, place int"))

    def merged(parts, order=()):
        rows = export.merge_exports(parts, order).collect()
        return sorted((r.entry_name, r.payload) for r in rows)

    assert merged([part(("p", "1", 0), ("q", "2", 0)), part(("q", "3", 0), ("r", "4", 0)),
                   part(("p", "5", 0))]) == [("p", "1"), ("q", "2"), ("r", "4")]
    # An entry that a part holds more than once, with and without an order.
    twice = [part(("p", "late", 9), ("p", "early", 2), ("q", "x", 1)), part(("p", "other", 0))]
    assert merged(twice, ["place"]) == [("p", "early"), ("q", "x")]
    rows = merged(twice)
    assert len(rows) == 2 and rows == merged(twice) and rows[0][1] in ("late", "early")
    assert merged([part(("p", "same", 1), ("p", "same", 1))]) == [("p", "same")]
    # Nulls in the order lose no entry.
    assert merged([part(("p", "none", None)), part(("p", "x", 1))], ["place"]) == [("p", "none")]
    assert merged([part(("p", "one", 1), ("p", "none", None))], ["place"]) == [("p", "none")]
    assert export.merge_exports([]).collect() == []


def test_a_merge_reads_parts_once_and_moves_rows_once(spark, tmp_path):
    spark.createDataFrame([("d", "p", "1")], "definition string, entry_name string, payload string") \
        .write.parquet(str(tmp_path / "a"))
    part = spark.read.parquet(str(tmp_path / "a"))
    plan = export.merge_exports([part, part])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1 and "partial_min" in plan


def test_nameless_records_are_no_entries(spark):
    df = spark.createDataFrame([("d", None), ("d", "http://www.x/y")],
                               "definition string, name string")
    assert [r.entry_name for r in export.entries(df).collect()] == ["xy"]


def test_summary(spark):
    records = spark.createDataFrame([("a",), ("a",), ("b",)], "archive string")
    archives = spark.createDataFrame([("a",), ("b",), ("c",)], "archive string")
    counts = summary.record_counts(records)
    assert {r.archive: r.records_read for r in counts.collect()} == {"a": 2, "b": 1}
    silent = summary.archives_without_records(archives, records)
    found = summary.problems(("warning", silent, "archive", "'none'"),
                             ("error", archives.where("archive = 'a'"), "archive", "'bad'"))
    assert tuple(summary.run_totals(counts, found).first()) == (3, 1, 1)
    assert tuple(summary.run_totals(counts.where("false"), found.where("false")).first()) == (
        0, 0, 0)


def test_definitions(tmp_path):
    for name, data in {"lines.txt": b"\t(?:mon|tues)day\r\nnoon  \n", "open.txt": b"(?P<year>",
                       "note.md": b"x", "blank.txt": b"\n", "_under.txt": b"x", ".hidden.txt": b"x",
                       "latin.txt": b"\xe9t\xe9", "v1.2.txt": b"\\bv\\d"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "dir.txt").mkdir()
    loaded = load_definitions(str(tmp_path))
    assert {d: p for d, p, _ in loaded.valid} == {
        "lines": "(?:mon|tues)day\nnoon", "blank": "", "_under": "x", "v1.2": r"\bv\d"}
    assert {d for d, _, _ in loaded.rejected} == {"open", "latin"}
    require_valid(loaded)
    with pytest.raises(ValueError, match="no .txt files"):
        require_valid(load_definitions(str(tmp_path / "missing")))
