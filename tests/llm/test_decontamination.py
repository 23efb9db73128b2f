import itertools
import random

import numpy as np

from gleanery.llm import decontamination as dec
from llm.conftest import words_of


def vocabulary(seed, n=4000):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def brute(doc, item, least=dec.LEAST_WORDS):
    """Whether any alignment has a stretch of enough words that agree enough."""
    if len(item) < dec.LEAST_ITEM:
        return False
    need = min(least, len(item))
    for diagonal in range(-len(item) + 1, len(doc)):
        low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        same = [doc[i + diagonal] == item[i] for i in range(low, high)]
        for a in range(len(same)):
            for b in range(a + need, len(same) + 1):
                if 5 * sum(same[a:b]) >= 4 * (b - a):
                    return True
    return False


def test_best_stretch():
    equal = np.array([0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 1], bool)
    assert dec.best_stretch(equal) == (4, 8, 4)
    assert dec.best_stretch(np.ones(5, bool)) == (0, 5, 5)
    assert dec.best_stretch(np.array([1] * 8 + [0] * 2 + [1] * 10, bool)) == (0, 20, 18)


def test_substitutions_are_tolerated(spark, documents):
    words, rng = vocabulary(1), random.Random(2)
    items, docs, planted = [], [], set()
    for i in range(12):
        items.append((i, " ".join(rng.choices(words, k=30)), "x"))
    for d in range(60):
        text = rng.choices(words, k=rng.randint(20, 300))
        if d % 2:
            passage = items[d % 12][1].split()
            for at in (6, 14, 23):                      # a tenth of the words replaced
                passage[at] = "other"
            text[10:10] = [w.upper() for w in passage]
            planted.add((d, d % 12))
        docs.append((d, "\n ".join(text), None, None))
    bench = spark.createDataFrame(items, "item_id bigint, text string, mark string")
    rows = dec.contaminated(documents([(*r, 0) for r in docs], ", seed int"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted
    assert all(r["start_word"] == 10 and r["item_word"] == 0 and r["n_words"] == 30
               and r["n_equal"] == 27 for r in rows)


def test_masks_miss_no_substitutions_that_are_allowed():
    """Every stretch that counts holds one of these lengths that counts."""
    for n in [*range(3, 14), 15, 20]:
        places = [sum(1 << (s + i) for i, c in enumerate(mask) if c == "1")
                  for mask in dec.masks_for(n) for s in range(n - len(mask) + 1)]
        for gone in itertools.combinations(range(n), n // 5):
            gone = sum(1 << i for i in gone)
            assert any(not place & gone for place in places), (n, bin(gone))


def test_longest_stretch():
    rng = np.random.default_rng(3)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 45)) < rng.choice([0.5, 0.75, 0.85])
        ok = [b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
              if 5 * equal[a:b].sum() >= 4 * (b - a)]
        start, end, same = dec.longest_stretch(equal)
        assert end - start == max(ok, default=0) and same == equal[start:end].sum()


def test_random_substitutions(spark, documents):
    """80 to 95 % of the words of an item or passage agree, whichever they are."""
    words, rng = vocabulary(7), random.Random(11)
    sizes = [(3, 0), (4, 0)] + [(n, n // 5) for n in range(5, 13)] + [
        (13, 1), (13, 2), (15, 2), (15, 3), (20, 1), (20, 4), (25, 5), (30, 6), (40, 2), (40, 8)]
    items = [(i, rng.choices(words, k=n)) for i, (n, _) in enumerate(sizes)]
    items.append((len(items), rng.choices(words, k=60)))
    docs, planted = [], set()
    for d in range(20 * len(sizes)):
        n, gone = sizes[d % len(sizes)]
        i, passage = items[d % len(sizes)] if n < 13 or d % 3 else items[-1]
        at = rng.randrange(len(passage) - n + 1)
        passage = passage[at:at + n]
        for k in rng.sample(range(n), gone):
            passage[k] = "other"
        docs.append((d, " ".join(rng.choices(words, k=9) + passage + rng.choices(words, k=9)),
                     None, None))
        planted.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id bigint, text string")
    rows = dec.contaminated(documents(docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted
    assert all(5 * r["n_equal"] >= 4 * r["n_words"] for r in rows)


def test_against_brute_force(spark, documents):
    """Short items, parts of items, and stretches about as long as counts."""
    words, rng = vocabulary(3, 300), random.Random(5)
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([3, 4, 5, 8, 9, 10, 14, 25])]
    docs = []
    for d in range(80):
        item = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(item) - 5))
        part = item[a:a + rng.randint(4, 20)]
        docs.append((d, " ".join(rng.choices(words, k=12) + part + rng.choices(words, k=9)), None, None))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dec.contaminated(documents(docs), bench).collect()}
    expected = {(d[0], i) for d in docs for i, text in items
                if brute(words_of(d[1]), words_of(text))}
    assert found == expected and expected


def test_a_text_of_many_items(spark, documents, monkeypatch):
    """Worked on in copies with some of the items each; the rows are the same."""
    words, rng = vocabulary(9), random.Random(6)
    items = [(i, " ".join(rng.choices(words, k=14))) for i in range(40)]
    docs = documents([(1, " ".join(t for _, t in items), None, None),
                      (2, items[3][1] + " x " + items[3][1], None, None)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(dec.contaminated(docs, bench).collect())
    assert {(r["doc_id"], r["item_id"]) for r in expected} == {(1, i) for i in range(40)} | {(2, 3)}
    monkeypatch.setattr(dec, "ITEMS", 3)
    monkeypatch.setattr(dec, "MAX_BROADCAST_BYTES", 10)
    assert sorted(dec.contaminated(docs, bench).collect()) == expected


def test_no_clean_document_of_a_table_is_hit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = dec.contaminated(docs, bench).collect()
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: words_of(r["text"]) for r in bench.collect()}
    # Every 13 words of an item that a document has count as an overlap.
    runs = {tuple(w[i:i + 13]): k for k, w in items.items() for i in range(len(w) - 12)}
    exact = {(d, runs[g]) for d, w in texts.items()
             for g in (tuple(w[i:i + 13]) for i in range(len(w) - 12)) if g in runs}
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert exact <= found
    for r in rows:
        a = texts[r["doc_id"]][r["start_word"]:r["start_word"] + r["n_words"]]
        b = items[r["item_id"]][r["item_word"]:r["item_word"] + r["n_words"]]
        assert sum(x == y for x, y in zip(a, b)) == r["n_equal"] >= 0.8 * r["n_words"]


def test_odd_rows(spark, documents):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    bench = spark.createDataFrame(
        [(1, passage), (1, passage), (None, passage + " omicron"), (3, None), (4, ""), (5, "alpha")],
        "item_id bigint, text string")
    docs = documents([(r, t, None, None, "w") for r, t in [
        (1, None), (2, ""), (3, "alpha"), (None, passage), (5, f"x {passage} y"),
        (5, f"x {passage} y"), (6, "word " * 300_000 + passage), (7, passage[:40])]], ", wins string")
    rows = dec.contaminated(docs, bench).collect()
    assert {r["doc_id"] for r in rows} == {None, 5, 6}
    assert len([r for r in rows if r["doc_id"] == 5]) == 2 * 3
    clean = dec.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 3, 7]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dec.contaminated(docs, none).collect() == []
    assert dec.decontaminated(docs, none).count() == 8
    assert dec.contaminated(documents([]), bench).collect() == []
