"""Scalar functions, on fixed cases and against plain Python on random input."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions import regex, text
from gleanery.functions.regex import find_all


def apply(spark, f, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


# Documented ranges of bytes that no text has: all controls but the bell,
# backspace, tab, line feed, form feed, carriage return and escape; and delete.
CONTROLS = [*range(0, 7), 11, *range(14, 27), *range(28, 32), 127]


def test_is_binary(spark):
    def expected(data):
        return any(data[i] in CONTROLS for i in range(min(len(data), 1024)))

    rng = random.Random(8)
    cases = [b"ab" + bytes([b]) for b in range(256)]
    cases += [b"", "Grüße\t1".encode(), b"\x7fELF", rng.randbytes(3000)]
    cases += [b" " * n + b"\x01" for n in (0, 1022, 1023, 1024, 1025)]
    assert apply(spark, text.is_binary, cases, "binary") == [expected(c) for c in cases]
    assert sum(map(expected, cases[:256])) == len(CONTROLS)


def test_decode_drops_invalid_bytes(spark):
    rng = random.Random(1)
    atoms = [b"a", b"\xff", b"\xc3", b"\xc3\xa9", b"\xf0\x9f\x98\x80", b"\xf0\x9f", b"\xe2\x82",
             "�".encode(), "﷐".encode(), b"\xed\xa0\x80", b"0", b"1", b"\xc0\x80",
             b"\xef", b"\xb7\x90", b"\xf4\x90\x80\x80"]
    cases = [b"".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(3000)]
    cases += [bytes(rng.randrange(256) for _ in range(40)) for _ in range(1000)]
    assert apply(spark, text.decode_lenient, cases, "binary") == [
        c.decode("utf-8", "ignore") for c in cases]


def test_base_and_report_names(spark):
    cases = ["in/mail.rx", "in/mail", "dates.iso.rx", "/etc/.rc", "in/", "", "v1.0/iban",
             "...x", "..x.y", "x.", "two\nlines.rx", "dir.d/.e.f"]
    assert apply(spark, text.base_name, cases, "string") == [
        os.path.splitext(os.path.basename(c))[0] for c in cases]
    assert apply(spark, text.report_name, ["a.b"], "string") == ["a.b_results.txt"]
    assert apply(spark, text.export_name, ["a.b"], "string") == ["a.b_results.zip"]


@pytest.mark.parametrize("name, entry", [
    ("http://www.b-c.net/q?a=1|2", "b-c.netqa=12"), ("https://a.org/<x>:y", "a.orgxy"),
    ("http://https://k", "k"), ("hthttp://tp://k", "httpk"), ("HTTPS://K", "HTTPSK"),
    ("wwwww..k", "ww.k"), ('\\p"q*', "pq"), ("", ""), (None, None)])
def test_entry_name(spark, name, entry):
    assert apply(spark, text.entry_name, [name], "string") == [entry]


def test_elapsed(spark):
    assert apply(spark, text.elapsed_text, [0.0, 61.239, 3600.5], "double") == [
        "0 minutes and 0.0 seconds", "1 minutes and 1.24 seconds", "60 minutes and 0.5 seconds"]


PATTERNS = [
    "abc", "aba", "a.c", "[a-z]+", "[^a-z]+", "[0-9]{2,}", "ab|cd", "(?:ab|cd)e?", "x[a-z]?y",
    r"\.", "[^<>\"]+", "^ab", "ab$", "k", "i", "s", "[aiks]+", "a{2}b", "(ab)?c", "K[a-z0-9]+",
    # not for the native path
    "", r"\w+", r"\d+", r"\s", r"\bab", "a*", "a*?", "|a", "(?:|ab)c?", "[A-Z]+", r"\Z", "(?P<n>a)b",
    "x{,2}", "[[a]", "[a&&b]", "(a|b)*", "(?=a)", "a++", r"(a)\1", "(?s).", "ß", "é+", "(?-i:Ab)",
]


def test_engines_agree(spark):
    rng = random.Random(2)
    alphabet = list("abckisxyABKIS019 .<\n\r\"&") + [
        "İ", "ı", "ſ", "K", "é", "É", "ß", "ẞ", " ", "\x1c", "²",
        "́", "😀", "٣"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["", "ab", "ab\n", "ababa", "baac", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string") \
        .withColumn("folded", regex.fold(F.col("t"))).cache()
    native = [p for p in PATTERNS if regex.runs_native(p)]
    assert {"abc", "[^a-z]+", "ab|cd", "(?:ab|cd)e?"} <= set(native)
    assert not {r"\w+", "a*?", "[A-Z]+", "x{,2}", "[[a]", "(a|b)*", r"\Z"} & set(native)
    defs = [regex.Definition(p, p) for p in PATTERNS]
    rows = df.select("t", *[find_all(F.col("t"), p, F.col("folded")).alias(f"n{i}")
                            for i, p in enumerate(native)],
                     regex.python_hits(F.lit(None).cast("string"), F.col("t"), defs)
                     .alias("hits")).collect()
    for row in rows:
        hits = {h.definition: h.content_matches for h in row.hits}
        for i, p in enumerate(native):
            assert row[f"n{i}"] == hits.get(p, []), (p, row.t)
        for p in PATTERNS:
            expected = [] if row.t is None else [
                m.group() for m in re.finditer(p, row.t, re.IGNORECASE)]
            assert hits.get(p, []) == expected, (p, row.t)


def test_only_known_characters_fold_to_ascii():
    letters = re.compile("[a-z]", re.IGNORECASE)
    found = {chr(c) for c in range(128, 0x110000)
             if letters.fullmatch(chr(c)) and chr(c).lower() not in "abcdefghijklmnopqrstuvwxyz"}
    assert found == set(regex.FOLDS_TO_ASCII)


def test_single_characters_agree(spark):
    """Every code point against native classes and letters."""
    patterns = ["[a-z]", "[^a-z]", "[0-9]", ".", "k", "i", "s", "[^<\"]", "[aeks]", "a"]
    df = spark.range(1, 0x30000).where("(id < 55296 or id > 57343) and id <> 65279") \
        .select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("t"))
    assert all(regex.runs_native(p) for p in patterns)
    native = df.select("id", "t", *[F.expr("1").alias("one")], *[
        (F.size(find_all(F.col("t"), p)) > 0).alias(f"n{i}") for i, p in enumerate(patterns)])
    counts = native.select(*[F.sum(F.col(f"n{i}").cast("int")).alias(f"n{i}")
                             for i in range(len(patterns))],
                           *[F.sum(F.when(F.col(f"n{i}"), F.col("id"))).alias(f"s{i}")
                             for i in range(len(patterns))]).first()
    for i, p in enumerate(patterns):
        rx = re.compile(p, re.IGNORECASE)
        found = [c for c in range(1, 0x30000)
                 if not 55296 <= c <= 57343 and c != 0xFEFF and rx.search(chr(c))]
        assert (counts[f"n{i}"], counts[f"s{i}"]) == (len(found), sum(found)), p


@pytest.mark.parametrize("pattern, literals", [
    ("license", ("license",)), ("a+bcd", ("bcd",)), ("(?:ab|cd)efg", ("efg",)),
    ("(Foo)bar", ("foobar",)), ("x?y?", ()), ("[a-z]+@", ("@",)), ("", ()),
    ("ab|cd", ("ab", "cd")), ("ab|", ()), (r"foo\bbar", ("foobar",)), ("abé", ("ab",)),
    ("(?x) a b # c", ("ab",)), ("(?:key|token)[a-z]*", ("key", "token")),
    ("(?:abc)+x", ("abc",)), ("(?:abc)*x", ("x",)), ("(?=abc)x", ("x",)),
    ("(?:a(?:bc|de)|f)", ("bc", "de", "f"))])
def test_required_literals(pattern, literals):
    assert regex.required_literals(pattern) == literals


def test_rejection():
    assert regex.rejection("[unclosed") and regex.rejection("(") and regex.rejection(r"\p{L}")
    assert regex.rejection("") is None and regex.rejection(r"\w+@\w+") is None


def test_dialects():
    definitions = [regex.Definition("a", "abc"), regex.Definition("b", r"\w")]
    assert regex.split_by_engine(definitions, "auto") == ([], definitions)
    assert regex.split_by_engine(definitions[:1], "auto") == (definitions[:1], [])
    assert regex.split_by_engine(definitions, "native") == (definitions, [])
    with pytest.raises(ValueError):
        regex.split_by_engine(definitions, "java")
    with pytest.raises(ValueError):
        regex.as_definitions([])
    with pytest.raises(ValueError):
        regex.as_definitions([("a", "x"), ("a", "y")])
