import re

import corpus_pipeline as cp
from gleanery.llm import decontamination, language, near_dup
from llm.conftest import words_of

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    """Every stage works on all its predecessor kept, and its decisions hold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in cp.STAGES:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    source, known, single, clean, mixed, shards = tables
    assert all(t.columns == columns for t in tables[:-1])

    preds = {r["doc_id"]: r for r in language.identify(source).collect()}
    assert {r["doc_id"] for r in known.collect()} == {
        i for i, r in preds.items() if r["lang_pred"] != "und" and r["score"] >= language.LEAST_SCORE}
    assert {r["doc_id"] for r in single.collect()} == {
        r["doc_id"] for r in near_dup.near_duplicates(known, cp.SHINGLE).collect() if r["kept"]}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontamination.contaminated(single, bench).collect()}
    assert hit and {r["doc_id"] for r in clean.collect()} == {
        r["doc_id"] for r in single.collect()} - hit

    rows, size, taken = {r["doc_id"]: r for r in clean.collect()}, 0, 0
    for r in mixed.collect():
        assert r == rows[r["doc_id"]]
        taken += len(words_of(r["text"]))
    size = sum(len(words_of(r["text"])) for r in rows.values())
    assert abs(taken / size - 1.5) < 0.05

    dealt = shards.collect()
    assert len(dealt) == mixed.count()
    sizes = [sum(r["shard"] == s for r in dealt) for s in range(cp.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(cp.SHARDS):
        assert sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(sizes[s]))


def test_clean_documents_stay(spark):
    """No document goes but for having no letters, a copy, or a passage."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"] for r in cp.language_id(spark, source, SF).collect()}
    for r in source.collect():
        if r["doc_id"] not in known:
            assert not re.search("[^\\W\\d_]{3}", r["text"] or "")


def test_run(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r["shard"] for r in rows} == set(range(cp.SHARDS))
