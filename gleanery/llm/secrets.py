r"""Secrets in texts: named patterns, and strings of high entropy.

Candidate strings are runs of the characters keys are made of.  A window slides
over each; the counts of the characters in it change by one in and one out, and
with them the sum of n * log2(n), from which the Shannon entropy follows.  What
entropy counts as high depends on the class of characters a candidate is made
of.  Strings on the allow-list, or with a part on it, are let pass.

DataFrame functions only; every text is worked on where it is read, without a
shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import let

# The named patterns, in the order in which they are listed.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
# Runs at least that long are the runs that remain when shorter ones are dropped.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_LENGTH = 8
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
# Runs at least as long as the window; those with a letter and a digit are candidates.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
# Bits per character from which a window counts, by the class of the candidate.
# No window of 20 has exactly these.
CLASSES = (("^[0-9a-fA-F]+$", 3.05), ("^[A-Z0-9]+$", 3.55), ("^[a-z0-9]+$", 3.55),
           ("", 3.85))
ALLOWED = ("example", "xxxxxxxx", "00000000", "abcdefgh", "12345678", "placeholder", "dummy")


def located(text: Column, pattern: str, check=None) -> Column:
    """Matches of ``pattern`` as structs (start, end, match), leftmost and not
    overlapping, in code points.  What lies between the matches, from ``split``,
    gives their places.  ``pattern`` must not match the empty string."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)

    def place(pair):
        def step(acc, part):
            start = acc.at + F.length(part.gap)
            end = start + F.length(part.match)
            return F.struct(end.alias("at"), F.concat(acc.out, F.array(F.struct(
                start.alias("start"), end.alias("end"), part.match.alias("match")))).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<struct<start:int,end:int,match:string>>").alias("out"))
        return F.aggregate(F.zip_with(
            pair.found, F.slice(pair.gaps, 1, F.size(pair.found)),
            lambda m, g: F.struct(g.alias("gap"), m.alias("match"))), zero, step).out

    places = F.when(text.rlike(pattern), let(
        F.struct(found.alias("found"), between.alias("gaps")), place)) \
        .otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    return F.filter(places, check) if check else places


def _entropy_table(n: int) -> Column:
    """n * log2(n) for counts from 0 to ``n``."""
    return F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(n + 1)])


def peak_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest entropy, in bits per character, of any ``window`` consecutive
    characters of an ASCII string that has at least as many.

    ``total`` is the sum of n * log2(n) over the counts in the window.  Each step adds
    the character that comes in and takes off the one that goes out; how often the
    window has these two is all that changes it.
    """
    # One more than the window holds: a character comes in before one goes out.
    table = _entropy_table(window + 1)

    def times(held, char):
        return F.length(held) - F.length(F.replace(held, char, F.lit("")))

    def over(chars):
        def slide(state, i):
            came = F.element_at(chars, i)
            low = F.greatest(i - window, F.lit(1))
            held = F.array_join(F.slice(chars, low, i - low), "")

            def step(now):
                n = times(now.held, now.came)
                total = state.total - F.element_at(table, n + 1) + F.element_at(table, n + 2)
                gone = F.element_at(chars, low)
                m = times(now.held, gone) + F.when(gone == now.came, 1).otherwise(0)
                return F.when(i > window, total - F.element_at(table, m + 1)
                              + F.element_at(table, m)).otherwise(total)

            total = let(F.struct(held.alias("held"), came.alias("came")), step)
            return let(total, lambda t: F.struct(t.alias("total"), F.when(
                i >= window, F.least(state.least, t)).otherwise(state.least).alias("least")))

        start = F.struct(F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, slide).least

    # One array of the characters, as places in a string are found by counting.
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return math.log2(window) - let(chars, over) / window


def high_entropy(text: Column, classes=CLASSES, allowed=ALLOWED) -> Column:
    """Whether a candidate is random enough for its class, and not allowed."""
    level = F.lit(classes[-1][1])
    for pattern, bits in reversed(classes[:-1]):
        level = F.when(text.rlike(pattern), bits).otherwise(level)
    known = F.lower(text).rlike("|".join(allowed)) if allowed else F.lit(False)
    return F.when(known, False).otherwise(peak_entropy(text) >= level)


def _marks(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def find_secrets(frame: DataFrame, text: str = "text") -> DataFrame:
    """``frame`` with ``base`` (spans of the named patterns) and ``extra`` (of
    high entropy, where no named pattern has found anything), both arrays of
    (start, kind, end), start and end in code points, kind numbered from 1 as in
    ``KINDS``.  A null text is an empty one, one of any length is gone through in time
    in proportion to it.  Columns named base or extra are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def spans(matches, kind):
        return F.transform(matches, lambda m: F.struct(
            m.start.alias("start"), F.lit(kind).alias("kind"), m.end.alias("end")))

    def long_enough(m):
        return F.length(F.regexp_extract(m.match, ASSIGN, 1)) >= ASSIGN_LENGTH

    base = F.concat(spans(located(body, ASSIGN, long_enough), 1),
                    spans(located(body, ACCESS), 2), spans(located(body, HEX), 3))
    found = frame.withColumn("base", base)
    fresh = located(body, CANDIDATE, lambda m: m.match.rlike("[0-9]") & m.match.rlike("[A-Za-z]")
                    & ~F.exists("base", lambda b: (b.start < m.end) & (m.start < b.end)))
    random = F.filter(fresh, lambda m: high_entropy(m.match))
    return found.withColumn("extra", F.when(F.size(fresh) > 0, spans(random, 4)).otherwise(
        F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def secret_report(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, counts of the named patterns, digest of
    their spans, all spans.  No match: counts of 0, the digest of nothing and an
    empty string."""
    found = find_secrets(documents.select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint")

    return found.select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(_marks(F.col("base")), 256).alias("base_sha256"),
        _marks(F.concat("base", "extra")).alias("spans"))
