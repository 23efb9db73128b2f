import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import words


def hashes_of(texts):
    out = []
    for i, j, hashes, bounds in words.word_hashes(pa.array(texts, pa.string())):
        out += [hashes[bounds[k]:bounds[k + 1]].tolist() for k in range(j - i)]
    return out


TEXTS = ["one Two\tTHREE\n one", None, "", "   ", "x", "é é é", "a" * 300, "tail \x0b\x0c\r "]


@pytest.mark.parametrize("piece", [8, 1 << 20])
def test_words_are_those_of_a_split(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    names = {}
    found = hashes_of(TEXTS)
    assert len(found) == len(TEXTS)
    for text, hashes in zip(TEXTS, found):
        expected = (text or "").encode().lower().split()
        assert len(hashes) == len(expected)
        for word, value in zip(expected, hashes):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_slices_of_a_column():
    column = pa.array(["skip", "one two", "three"], pa.string()).slice(1)
    (_, _, hashes, bounds), = words.word_hashes(column)
    assert bounds.tolist() == [0, 2, 3]
    assert hashes.tolist() == [x for t in hashes_of(["one two", "three"]) for x in t]


def test_shingles_of_few_words():
    two = np.array([1, 2], np.uint64)
    assert len(words.shingles(two, 5)) == 1
    assert words.shingles(two, 5)[0] != words.shingles(two, 1)[0]
    assert len(words.shingles(np.arange(9, dtype=np.uint64), 5)) == 5
    assert len(words.shingles(np.empty(0, np.uint64), 5)) == 0
