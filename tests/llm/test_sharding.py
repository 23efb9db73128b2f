import zlib
from math import comb

import pytest
from pyspark.sql import functions as F

from gleanery.llm import sharding


def law_holds(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    law_holds(rows, 8)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_reruns_agree_and_seeds_differ(spark):
    frame = spark.range(500)
    first = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(frame, 4).collect()}
    again = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(frame, 4).collect()}
    other = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(frame, 4, 7).collect()}
    assert first == again and first != other


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None, 5)] * 40 + [(1, "", 6)] * 30 + [(2, "x" * 200_000, 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, shard int") \
        .withColumn("part", F.lit("mine"))
    out = sharding.shard_rows(frame, 3)
    assert out.columns == ["doc_id", "text", "part", "shard", "slot"]
    found = out.collect()
    law_holds(found, 3)
    assert sum(r["doc_id"] is None for r in found) == 40
    manifest = sharding.shard_documents(frame).collect()
    assert {(r["size"], r["text_crc32"]) for r in manifest if r["doc_id"] is None} == {(1, 0)}


def test_empty_and_fewer_rows_than_shards(spark):
    assert sharding.shard_rows(spark.range(0), 4).collect() == []
    law_holds(sharding.shard_rows(spark.range(3), 8).collect(), 8)


@pytest.mark.parametrize("good,bad,draws", [(30, 70, 20), (3, 400, 50), (500, 2, 400)])
def test_hypergeometric_law(spark, good, bad, draws):
    n = 20_000
    u = sharding.unit(F.lit(good), F.col("id"))
    drawn = spark.range(n).select(sharding.hypergeometric(
        u, F.lit(float(good)), F.lit(float(bad)), F.lit(float(draws))).alias("x"))
    counts = {int(r[0]): r[1] for r in drawn.groupBy("x").count().collect()}
    # Chi-square over cells of 5 and more; its spread is sqrt(2 * cells).
    cells, total = 0, 0.0
    for k in range(max(0, draws - bad), min(draws, good) + 1):
        expected = n * comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        if expected >= 5:
            cells += 1
            total += (counts.get(k, 0) - expected) ** 2 / expected
        assert expected > 1e-6 or k not in counts
    assert total < cells + 6 * (2 * cells) ** 0.5
    assert set(counts) <= set(range(max(0, draws - bad), min(draws, good) + 1))


def test_matrix_has_the_given_sums(spark):
    sizes = [5, 0, 17, 100, 3, 41]
    counts = spark.createDataFrame(list(enumerate(sizes)), "part int, n bigint")
    rows = sorted(sharding.communication_matrix(counts, 4, 1).collect())
    sent = [[b - a for a, b in zip([0, *r["until"]], r["until"])] for r in rows]
    assert [sum(r) for r in sent] == sizes
    columns = [sum(c) for c in zip(*sent)]
    assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1
    assert all(x >= 0 for r in sent for x in r)


def test_pairs_meet_as_in_a_uniform_shuffle(spark):
    """Any two rows are in one shard of 4 with probability about 1/4."""
    together = 0
    for seed in range(6):
        shard = {r["id"]: r["shard"] for r in
                 sharding.shard_rows(spark.range(400), 4, 1000 + seed).collect()}
        together += sum(shard[i] == shard[i + 1] for i in range(0, 400, 2))
    assert 0.18 < together / 1200 < 0.32
