"""The literal test never loses a match: random patterns on random texts."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import regex

ATOMS = st.sampled_from(["a", "b", "k", "s", "i", "K", "S", "I", "[ab]", "[^a]", ".", r"\w", r"\.",
                         "é", "^", "$", r"\b", "(?=a)", "(?!b)", "(?-i:K)", "s{2}"])


def combine(inner):
    return st.one_of(
        st.lists(inner, min_size=1, max_size=4).map("".join),
        st.lists(inner, min_size=1, max_size=3).map(lambda p: f"(?:{'|'.join(p)})"),
        inner.map(lambda p: f"({p})"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{0,2}", "{1,3}", "{2}", "*?", "+?"]))
        .map(lambda p: f"(?:{p[0]}){p[1]}"))


PATTERNS = st.recursive(ATOMS, combine, max_leaves=8)
TEXTS = st.text(st.sampled_from("abksiABKSI.éÉ \nİıſK̇"), max_size=14)


@settings(max_examples=1500, deadline=None)
@given(PATTERNS, TEXTS, TEXTS)
def test_search_equals_finditer(pattern, name, text):
    rx = re.compile(pattern, re.IGNORECASE)
    expected = [[m.group() for m in rx.finditer(value)] for value in (name, text)]
    hits = regex.python_search([regex.Definition("d", pattern)])(name, text)
    assert hits == ([("d", *expected)] if any(expected) else [])


@settings(max_examples=500, deadline=None)
@given(PATTERNS)
def test_native_patterns_cannot_match_nothing(pattern):
    if regex.runs_native(pattern):
        assert re.compile(pattern, re.IGNORECASE).search("") is None


def test_native_engine_equals_python_on_random_patterns(spark):
    rng = random.Random(6)
    atoms = ["a", "b", "k", "s", "i", "K", "S", "ab", "[ab]", "[^a]", "[a-k]", "[^a-k]", "[0-9]",
             ".", r"\.", "-", "[is]", "^", "$"]

    def pattern():
        parts = [rng.choice(atoms) + rng.choice(["", "", "", "+", "*", "?", "{2}", "{1,2}"])
                 for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts)), f"(?:{rng.choice(atoms)}|{rng.choice(atoms)})"
                         + rng.choice(["", "?"]))
        if rng.random() < 0.2:
            parts.insert(rng.randrange(1, len(parts) + 1), "|")
        return "".join(parts)

    patterns = set()
    while len(patterns) < 150:
        p = pattern()
        if regex.rejection(p) is None and regex.runs_native(p):
            patterns.add(p)
    patterns = sorted(patterns)
    texts = ["".join(rng.choice("abksiABKS019.-é \n\rİıſK😀") for _ in range(rng.randrange(16)))
             for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string") \
        .withColumn("folded", regex.fold(F.col("t"))).cache()
    for some in (patterns[i:i + 30] for i in range(0, len(patterns), 30)):
        found = df.select("t", F.array(*[
            F.array_join(regex.find_all(F.col("t"), p, F.col("folded")), "|") for p in some])
            .alias("found"), F.array(*[
                F.size(regex.find_all(F.col("t"), p)) for p in some]).alias("sizes"))
        for row in found.collect():
            for p, got, size in zip(some, row.found, row.sizes):
                expected = [m.group() for m in re.finditer(p, row.t, re.IGNORECASE)]
                assert (got, size) == ("|".join(expected), len(expected)), (p, row.t)
