import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from gleanery.llm import line_dedup
from gleanery.llm.common import Scratch


def brute(rows, least=10, least_chars=1):
    """(doc_id, kept text, n_lines, n_dropped) of every row, sorted."""
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    split = [(row[0], (row[1] or "").split("\n")) for row in rows]
    times = Counter(k for _, lines in split for k in {key(line) for line in lines})
    found = []
    for doc_id, lines in split:
        kept = [line for line in lines
                if not (len(key(line)) >= least_chars and times[key(line)] >= least)]
        found.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(found, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "text", "n_lines", "n_dropped")
                   .collect()), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    common = [f"Common line {i}" for i in range(12)] + ["", " ", "Été", "\tÉTÉ "]
    rows = []
    for i in range(n):
        lines = [rng.choice(["", " ", "\x0b"]) + rng.choice([str.upper, str])(rng.choice(common))
                 if rng.random() < 0.6 else f"own {rng.randrange(n * 4)}"
                 for _ in range(rng.randrange(0, 12))]
        rows.append((i, "\n".join(lines), "en", "s"))
    return rows


def test_brute_force(documents):
    rows = made(1, 150) + [(500, None, None, None), (501, "", None, None), (502, "\n\n", "", ""),
                           (None, "common line 3\nmine", "en", "s")]
    rows += [(7000 + i, "copy of all\nCommon line 1", "en", "s") for i in range(10)]
    rows += [(9000, "same id\n", "en", "s")] * 12
    frame = documents(rows).repartition(7)
    assert got(line_dedup.without_common_lines(frame)) == brute(rows)
    assert got(line_dedup.without_common_lines(frame, 3, 5, batches=3)) == brute(rows, 3, 5)


def test_any_number_of_batches_and_partitions(documents):
    rows = made(2, 120)
    expected = brute(rows, 4)
    for partitions, batches in ((1, 1), (3, 9), (5, 2)):
        frame = documents(rows).repartition(partitions)
        assert got(line_dedup.without_common_lines(frame, 4, batches=batches)) == expected


def test_nine_documents_are_too_few_and_ten_enough(documents):
    rows = [(i, "nine\nten" if i < 9 else "ten", "en", "s") for i in range(10)]
    found = got(line_dedup.without_common_lines(documents(rows).repartition(4)))
    assert found == sorted([(i, "nine", 2, 1) for i in range(9)] + [(9, "", 1, 1)], key=repr)


def test_a_very_long_text_and_one_line_in_most(documents):
    text = "\n".join(["header"] + [f"line {i % 70_000}" for i in range(200_000)])
    rows = [(0, text, "en", "s")] + [(i, f"HEADER\nbody {i}", "en", "s") for i in range(1, 60)]
    found = got(line_dedup.without_common_lines(documents(rows)))
    assert found == brute(rows)
    assert (0, 200_001, 1) in [(d, n, gone) for d, _, n, gone in found]


def test_empty_table_and_clashing_columns(spark, documents):
    assert got(line_dedup.without_common_lines(documents([]))) == []
    rows = [(i, "a\nb", "en", "s", i, "x", 0.5) for i in range(10)]
    frame = documents(rows, ", n bigint, line string, batch double")
    assert got(line_dedup.without_common_lines(frame)) == [(i, "", 2, 2) for i in range(10)]
    assert line_dedup.line_digests(frame).columns == [
        "doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert {r.kept_sha256 for r in line_dedup.line_digests(frame).collect()} == {
        hashlib.sha256(b"").hexdigest()}


def _exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("Sort ")


def test_runs_are_levelled_and_merged_without_a_shuffle(spark):
    """Batches of hashes, of which some are common from the second batch on."""
    def digest(k):
        return hashlib.md5(str(k).encode()).digest()

    runs = line_dedup.LineRuns(Scratch(spark, "test"), least=3)
    for batch in range(5):
        runs.add(spark.range(200).select(
            F.unhex(F.md5((F.col("id") % 90 + batch).cast("string"))).alias("line")))
    assert [name is not None for name in runs.levels] == [True, False, True]
    low, high = runs.levels[0], runs.levels[2]
    with runs._sorted_scans():
        assert _exchanges(runs.merged(low, high)) == (0, 0)
        stored = runs.scratch.sorted_table(low)
        assert _exchanges(runs.uncommon(stored))[0] == 0
    # Hashes that were common in the run of four batches are not in the fifth.
    in_high = {bytes(r.line) for r in runs.scratch.sorted_table(high).where("n >= 3").collect()}
    in_low = {bytes(r.line) for r in stored.collect()}
    assert in_high and in_low and not in_high & in_low
    counts = Counter(i % 90 + batch for batch in range(5) for i in range(200))
    expected = {digest(k) for k, n in counts.items() if n >= 3}
    assert {bytes(r.line) for r in runs.common().collect()} == expected
    runs.close()
