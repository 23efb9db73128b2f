import random
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import near_dup
from llm.conftest import words_of


def shingle_set(text, k):
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k):
    """{position: (set size, least id of the component)} over all pairs that
    share a shingle."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = {}
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in inverted.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            inverted.setdefault(g, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)),
                  key=str)


def found(frame, k):
    rows = near_dup.near_duplicates(frame, k).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force_on_a_table(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, k) == brute(rows, k)


def family(rng, words, size, length, changes):
    base = rng.choices(words, k=length)
    out = []
    for _ in range(size):
        text = list(base)
        for at in rng.sample(range(length), changes):
            text[at] = rng.choice(words)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("depth,large", [(12, 8192), (5, 20)])
def test_large_groups(documents, monkeypatch, depth, large):
    """Families whose members are partly similar to each other, larger than a
    leaf: compared in blocks at once, or after branching on."""
    monkeypatch.setattr(near_dup, "MAX_DEPTH", depth)
    monkeypatch.setattr(near_dup, "LEAF", 8)
    monkeypatch.setattr(near_dup, "LARGE", large)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = family(rng, words, 120, 60, 2) + family(rng, words, 60, 60, 3) \
        + family(rng, words, 60, 60, 5) + ["same text over and over again"] * 50 \
        + [" ".join(rng.choices(words, k=40)) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = documents([(i, t, None, None) for i, t in rows])
    assert found(frame, 2) == brute(rows, 2)


def test_branching_keeps_alike_texts_together():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, (200, 400), dtype=np.uint64)
    b = a.copy()
    b[:, :44] = rng.integers(0, 1 << 63, (200, 44), dtype=np.uint64)       # similarity 0.8
    met = 0
    for x, y in zip(a, b):
        signs = np.stack([near_dup.signature(x), near_dup.signature(y)])
        nodes = [np.arange(1, near_dup.TREES + 1, dtype=np.uint64)] * 2
        for _ in range(5):
            nodes = [near_dup.branch(n, np.repeat(signs[i:i + 1], len(n), 0))[1]
                     for i, n in enumerate(nodes)]
        met += bool(set(nodes[0].tolist()) & set(nodes[1].tolist()))
    assert met >= 198


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"),
       (8, "two one"), (9, "a b c " * 60_000), (10, "a b c " * 50_000), (11, "x y z"), (11, "x y z"),
       (11, "q r s t")]


def test_odd_rows(documents):
    frame = documents([(i, t, None, None, 0, "m") for i, t in ODD], ", comp int, mark string")
    assert found(frame, 2) == brute(ODD, 2)
    kept = near_dup.without_near_duplicates(frame, 2)
    assert kept.columns == frame.columns
    ids = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] != 9)
    assert ids == [(1, None), (2, ""), (3, "  \n"), (4, "one"), (6, "one two"), (8, "two one"),
                   (11, "q r s t"), (11, "x y z")]
    assert near_dup.near_duplicates(documents([]), 2).collect() == []
    assert near_dup.without_near_duplicates(documents([])).collect() == []


def test_one_document_of_each_group_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = near_dup.near_duplicates(docs, 5).collect()
    kept = sorted(r["doc_id"] for r in near_dup.without_near_duplicates(docs, 5).collect())
    assert kept == sorted(r["doc_id"] for r in rows if r["kept"])
