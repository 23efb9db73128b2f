import zlib

import numpy as np
import pyarrow as pa

from gleanery.llm import language
from gleanery.llm.words import raw_texts


def grams_of(text):
    data, offsets = raw_texts(pa.array([text], pa.string()))
    grams, bounds, letters = language.ngrams(data, offsets)
    return grams, int(letters[0])


def test_ngrams_of_letters():
    assert len(grams_of("abcd")[0]) == 3                      # " abc", "abcd", "bcd "
    assert np.array_equal(grams_of("ABcd!!")[0], grams_of("abcd")[0])
    assert np.array_equal(grams_of("ab12 34cd")[0], grams_of("ab cd")[0])
    assert grams_of("12 .,")[1] == 0 and len(grams_of("")[0]) == 0
    assert grams_of("é😀x")[1] == 2


def test_texts_do_not_touch():
    data, offsets = raw_texts(pa.array(["abcd", None, "", "xyz", "9"], pa.string()))
    grams, bounds, letters = language.ngrams(data, offsets)
    assert letters.tolist() == [4, 0, 0, 3, 0]
    assert np.diff(bounds).tolist() == [3, 0, 0, 2, 0]
    assert np.array_equal(grams[bounds[3]:bounds[4]], grams_of("xyz")[0])


def test_bit_sliced_filters_give_all_languages_of_an_ngram():
    names = [f"l{i:03}" for i in range(70)]
    grams = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = {}
    for i, gram in enumerate(grams):
        for k in {i % 70, (i * 7) % 70}:
            for slot in language.slots_of(np.array([gram])):
                key = (int(slot[0]), k // 64)
                rows[key] = rows.get(key, 0) | 1 << k % 64
    filters = language.Filters(names, [(s, w, b) for (s, w), b in rows.items()])
    counts = filters.counts(grams, np.arange(len(grams) + 1))
    for i in range(len(grams)):
        expected = {i % 70, (i * 7) % 70}
        assert expected <= set(np.flatnonzero(counts[i]))
    assert counts.sum() <= sum(len({i % 70, (i * 7) % 70}) for i in range(len(grams))) + 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(found) == set(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held == [i for i in truth if found[i]["held_out"]]
    right = sum(found[i]["lang_pred"] == truth[i] for i in held)
    assert right >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


LEARN = [(i, text, lang, None) for i, (text, lang) in enumerate(
    [("the house and the garden with the tree", "en"), ("das haus und der garten mit dem baum", "de")]
    * 12)]


def test_odd_rows(documents):
    odd = [(100, None, None, None), (101, "", "de", None), (102, "12 34 !?", None, None),
           (None, "the tree and the house", None, None), (104, "das haus und " * 200_000, None, None),
           (104, "das haus", None, None)]
    docs = documents([(*r, 1.0) for r in LEARN + odd], ", score double")
    found = [(r["doc_id"], r["lang_pred"]) for r in language.identify(docs).collect()]
    assert len(found) == len(LEARN) + len(odd)
    assert {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (104, "de")} <= set(found)
    kept = language.in_known_language(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {100, 101, 102} & set(ids) and ids.count(104) == 2 and None in ids
    assert len(ids) == len(LEARN) + 3


def test_unlearned_language_is_rejected(documents):
    docs = documents(LEARN + [(200, "жили были старик со старухой у самого синего моря", None, None)])
    kept = [r["doc_id"] for r in language.in_known_language(docs).collect()]
    assert sorted(kept) == [r[0] for r in LEARN]


def test_nothing_to_learn_from(documents):
    assert language.identify(documents([])).collect() == []
    rows = language.identify(documents([(1, "words here", None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
    assert language.in_known_language(documents([])).collect() == []
