"""Search in windows and in chunks equals the search of the whole."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.functions import regex, windows
from gleanery.functions.chunks import ChunkSearch
from gleanery.operators import matches
from gleanery.plans.table import prepare_table, search_table, search_table_chunks

DEFINITIONS = {"empty": "", "stars": "a*", "word": r"\b\w+\b", "line": "(?m)^.*$", "dot": "(?s).b",
               "back": r"(a|b)\1", "ahead": "b(?=.*k)", "links": '"[^"]*"', "tail": r"k\Z",
               "flag": "(?-i:K)a?", "behind": "(?<=ab)k"}
# No reach: a reference, and flags of a part.
WITHOUT_REACH = {"back", "flag"}


def found_in_pieces(pattern, pieces, window):
    matcher = regex.Matcher([regex.Definition("d", pattern)])
    search = windows.WindowSearch(matcher, windows.reaches(matcher), window)
    found = [m for piece in pieces for _, m in search.feed(piece)]
    return found + [m for _, m in search.finish()]


@pytest.mark.parametrize("name", sorted(set(DEFINITIONS) - WITHOUT_REACH))
def test_equal_at_every_cut(name):
    rng = random.Random(name)
    for _ in range(6):
        text = "".join(rng.choice('abkK" \n.é') for _ in range(60))
        expected = re.findall(DEFINITIONS[name], text, re.IGNORECASE)
        for cut in range(len(text) + 1):
            assert found_in_pieces(DEFINITIONS[name], [text[:cut], text[cut:]], 1) == expected
        assert found_in_pieces(DEFINITIONS[name], list(text), 1) == expected


def test_random_patterns_random_cuts():
    rng = random.Random(11)
    atoms = ["a", "b", "[ab]", "[^a]", ".", r"\w", "^", "$", r"\b", r"\B", "(?=a)", "(?!b)", "(?<=a)",
             "(?<!b)", "(?=a*b)", "\n", r"\Z", r"\A", "(?<=^a)", "", "a*", "b+?", "(?>a*)", "a*+"]

    def pattern(depth):
        kind = rng.random()
        if not depth or kind < 0.4:
            return rng.choice(atoms)
        parts = [pattern(depth - 1) for _ in range(rng.randrange(1, 4))]
        if kind < 0.6:
            return "".join(parts)
        if kind < 0.75:
            return f"(?:{'|'.join(parts)})"
        return f"(?:{parts[0]})" + rng.choice(["*", "+", "?", "{0,2}", "{1,3}", "*?", "+?", "{2,}"])

    tried = 0
    while tried < 4000:
        source = rng.choice(["", "", "(?m)", "(?s)", "(?a)"]) + pattern(3)
        if regex.rejection(source) or windows.reach(source) is None:
            continue
        tried += 1
        text = "".join(rng.choice("abksAB \n.éK") for _ in range(rng.randrange(30)))
        cuts = [0, *sorted(rng.choices(range(len(text) + 1), k=4)), len(text)]
        expected = [m.group() for m in re.finditer(source, text, re.IGNORECASE)]
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        assert found_in_pieces(source, pieces, rng.choice([1, 3])) == expected, source


@pytest.mark.parametrize("pattern, found", [
    ("abc", (1, 5, False)), ("a{2,4}b?", (1, 7, False)), ('<a href="[^"]*"', (1, 12, True)),
    ("a.*b", (1, 4, True)), ("(?<=abc)d(?=e+)", (4, 6, True)), (r"(a)\1", None),
    ("(?-i:a)", None), ("(?:a{9999}){9999}", None)])
def test_reach(pattern, found):
    reach = windows.reach(pattern)
    assert (reach and (reach.behind, reach.barriers, reach.barrier is not None)) == found


def test_windows_forget_the_text():
    """What is held does not grow with the text."""
    patterns = {"links": '<a href="[^"]*"', "line": "x.*y", "mail": r"[\w.]+@[\w.]+", "rare": "q{3}"}
    matcher = regex.Matcher([regex.Definition(*d) for d in patterns.items()])
    reaches = windows.reaches(matcher)
    assert len(reaches) == 4
    search = windows.WindowSearch(matcher, reaches, 1 << 16)
    piece = 'some words x and y\n<a href="http://h/p">a.b@c.de</a>\n' * 500
    most, found = 0, Counter()
    for _ in range(1500):
        found.update(i for i, _ in search.feed(piece))
        most = max(most, len(search.text) + search.size)
    found.update(i for i, _ in search.finish())
    # 40 million characters.
    assert most < 300_000
    assert found == {0: 750_000, 1: 750_000, 2: 750_000}


def test_chunks_hold_all_matches():
    rng = random.Random(3)
    for size in (1, 3, 7, 1000):
        searcher = ChunkSearch([regex.Definition(*d) for d in DEFINITIONS.items()], size, window=16)
        for _ in range(40):
            text = "".join(rng.choice('abkK" \n') for _ in range(rng.randrange(90)))
            name = text[:5]
            expected = {d: (n, t) for d, n, t in searcher.matcher.search(name, text)}
            cut = [text[i:i + 9] for i in range(0, len(text), 9)]
            for rows in (list(searcher.whole(name, text)), list(searcher.pieces(name, cut))):
                got, count = {}, Counter()
                for definition, chunk, whole, names, texts in rows:
                    assert chunk == count[definition] and 0 < len(names) + len(texts) <= size
                    count[definition] += 1
                    held = got.setdefault(definition, ([], []))
                    assert not (names and held[1])
                    held[0].extend(names)
                    held[1].extend(texts)
                assert got == expected
                assert all(whole == (count[d] == 1) for d, _, whole, _, _ in rows)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    rows = [(i, "a%d" % i, "".join(rng.choice('abkK" \n') for _ in range(rng.randrange(200))))
            for i in range(60)] + [(100, None, None), (101, "", ""), (102, "aa", None)]
    return spark.createDataFrame(rows, "id bigint, name string, text string").repartition(3)


@pytest.mark.parametrize("size, window", [(3, None), (3, 10), (1, 1), (3_000_000, None)])
def test_tables_of_chunks(texts, size, window):
    """Counts and numbers are the same whatever a chunk holds."""
    pairs = search_table(texts, ["id"], "name", "text", DEFINITIONS)
    chunks = search_table_chunks(texts, ["id"], "name", "text", DEFINITIONS,
                                 chunk_matches=size, window=window)
    pair = ["id", "name", "definition", "scope"]

    def rows(frame, *columns):
        return sorted(map(repr, frame.select(*pair, *columns).collect()))

    totals = matches.match_counts(pairs).select(
        *pair, F.col("total").cast("bigint").alias("total"),
        F.size("unique").cast("bigint").alias("uniques"),
        F.col("duplicates").cast("bigint").alias("duplicates"))
    assert rows(matches.chunk_totals(chunks), "total", "uniques", "duplicates") == \
        rows(totals, "total", "uniques", "duplicates")
    items = matches.match_items(pairs).withColumn("item", F.col("item").cast("bigint"))
    assert rows(matches.chunk_items(chunks), "item", "match") == rows(items, "item", "match")


def test_chunks_need_no_shuffle_for_single_ones(texts):
    chunks = search_table_chunks(texts, ["id"], "name", "text", {"b": "b"}).where("whole")
    plan = matches.match_counts(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition of the fixture


def test_no_columns_clash(texts):
    frame = texts.withColumn("chunk_of", F.lit(1)).withColumn("kept", F.lit(2))
    found = search_table_chunks(frame, ["id", "chunk_of"], "name", "text", {"b": "b"})
    assert found.columns == ["id", "chunk_of", "name", "definition", "chunk", "whole",
                             "name_matches", "content_matches"]
    assert prepare_table(frame, ["id"], "name", "text").columns[:3] == ["id", "name", "text"]


def test_many_definitions_use_one_automaton():
    """The literal test over many definitions finds what each by itself finds."""
    rng = random.Random(4)
    patterns = ["".join(rng.choice("abkis") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    definitions = [regex.Definition(f"d{i}", p + rng.choice(["", "+", "|é", ".*", "[0-9]?"]))
                   for i, p in enumerate(patterns)]
    matcher = regex.Matcher(definitions)
    assert matcher._literal_automaton()[0] is not None
    for _ in range(150):
        text = "".join(rng.choice("abkisABKIS19é \u212aſİ") for _ in range(rng.randrange(40)))
        expected = [(d.definition, [], [m.group() for m in re.finditer(d.pattern, text, re.I)])
                    for d in definitions if re.search(d.pattern, text, re.I)]
        assert matcher.search(None, text) == expected
        assert matcher.matching(text, None) == [d for d, _, _ in expected]


def test_without_the_automaton(monkeypatch):
    definitions = [regex.Definition(f"d{i}", f"word{i}x") for i in range(100)]
    expected = regex.Matcher(definitions).search("word3x", "Word5X word99x")
    monkeypatch.setattr(regex, "ahocorasick", None)
    assert regex.Matcher(definitions).search("word3x", "Word5X word99x") == expected
    assert [d for d, _, _ in expected] == ["d3", "d5", "d99"]


def test_runs_in_front_take_no_quadratic_time():
    """The work is counted: a run is gone through once, not once from each place."""
    for pattern in ("[a-z, ]{20,}[.]", "[^\n]*ende[^\n]*", "[a-z0-9.+-]+@[a-z0-9-]+[.][a-z]+"):
        text = ("ab " * 100_000 + "\n") if "@" not in pattern else "a" * 300_000 + "\n"
        text += "so long a sentence as this one is ende.\nx@y.org\n"
        began = time.process_time()
        found = found_in_pieces(pattern, [text[i:i + 300] for i in range(0, len(text), 300)], 300)
        whole = regex.Matcher([regex.Definition("d", pattern)]).find_all(0, text)
        assert found == whole and len(whole) == 1
        assert time.process_time() - began < 20


def test_runs_in_front_find_what_re_finds():
    rng = random.Random(5)
    runs = ["a", "[ab]", "[^a]", ".", r"[\w.]", r"[^\n]", "K"]
    counts = ["*", "+", "{2,}", "*?", "+?", "{3,}?"]
    rests = ["b", "a", "ab", "[ab]b?", "(b|k)x?", r"\b.", "(?<=ab)k", "$.?b", "(a)\\1", "a*b", "b(?!a)", ".{2}"]
    guarded = 0
    for _ in range(4000):
        source = rng.choice(runs) + rng.choice(counts) + rng.choice(rests)
        text = "".join(rng.choice("aabbkK\u212a .\n") for _ in range(rng.randrange(30)))
        guarded += regex.leading_run(source) is not None
        rx, own = re.compile(source, re.IGNORECASE), regex.compiled(source)
        at = rng.randrange(len(text) + 1)
        assert [m.span() for m in own.finditer(text, at)] == [m.span() for m in rx.finditer(text, at)], source
        assert bool(own.search(text)) == bool(rx.search(text))
        assert found_in_pieces(source, list(text), 1) == [m.group() for m in rx.finditer(text)] \
            or windows.reach(source) is None
    assert guarded > 3000
    for source in ("", "a*", "(?s).*b", "(a+)b", "a++b", "(?:ab)*c", "a|b+c", "a{2,5}b"):
        assert regex.leading_run(source) is None
