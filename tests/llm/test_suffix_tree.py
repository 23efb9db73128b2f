import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gleanery.llm import suffix_tree as st
from gleanery.llm.words import raw_texts
from llm.conftest import words_of


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def stream_of(texts):
    data, offsets = raw_texts(pa.array(texts, pa.string()))
    return st.canonical(data, offsets)


def written(text):
    return b" ".join(words_of(text)) + b"\n"


TEXTS = ["  One two\t\n three ", None, "", "x", "É é  \x0b", "a\n"]


def test_canonical_text():
    stream, ends = stream_of(TEXTS)
    expected = b"".join(b"\x0b" * st.DEPTH + written(t) for t in TEXTS) + b"\x0b" * st.DEPTH
    assert stream.tobytes() == expected
    assert [expected[i] for i in ends] == [10] * len(TEXTS)


def test_counter_is_exact(monkeypatch):
    monkeypatch.setattr(st, "HOLD", 50)
    rng, counter, total = np.random.default_rng(2), st.Counter(), Counter()
    seen = Counter()
    for _ in range(40):
        values = rng.integers(0, 90, 30).astype(np.uint64)
        total.update(values.tolist())
        if (out := counter.add(values)) is not None:
            seen.update(dict(zip(out[0].tolist(), out[1].tolist())))
    if (out := counter.flush()) is not None:
        seen.update(dict(zip(out[0].tolist(), out[1].tolist())))
    assert seen == total


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.uint64))
    table = st.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1 << 61)) == -1).all()
    assert (st.Table(np.empty(0, np.uint64)).find(keys) == -1).all()


def tree_of(texts, contexts):
    """A tree with the given states (bytes) and its counts, by brute force."""
    counts = Counter()
    for t in texts:
        s = b"\x0b" * st.DEPTH + written(t)
        for i in range(st.DEPTH, len(s)):
            for k in range(st.DEPTH + 1):
                counts[s[i - k:i], s[i]] += 1

    def key(context, symbol):
        return int.from_bytes(context + bytes([symbol]), "big")

    levels = []
    for k in range(st.DEPTH + 1):
        rows = [(key(c, x), n) for (c, x), n in counts.items()
                if len(c) == k and (k == 0 or c in contexts)]
        levels.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])))
    return st.Tree(levels), counts


def brute_prob(counts, contexts, context, symbol):
    """Of the longest state that ends the context, smoothed along its suffixes."""
    k = max(j for j in range(len(context) + 1)
            if j == 0 or context[len(context) - j:] in contexts)
    tail = context[len(context) - k:]
    seen = {x: n for (c, x), n in counts.items() if c == tail}
    total = sum(seen.values())
    if k == 0:
        return (seen.get(symbol, 0) + 1) / (total + 256)
    shorter = brute_prob(counts, contexts, tail[1:], symbol)
    return (seen.get(symbol, 0) + len(seen) * shorter) / (total + len(seen))


def test_scores_of_longest_states():
    texts = ["the cat sat on the mat", "the hat", "a cat and a hat", "that mat"] * 3
    contexts = {b"t", b"h", b"e", b" ", b"th", b"at", b"he", b"the", b" the", b"\x0b"}
    tree, counts = tree_of(texts, contexts)
    stream, _ = stream_of(["the chat hath zeal", "that"])
    at = np.flatnonzero(stream != st.PAD)
    logs = tree.log10(st.packed(stream, at))
    raw = stream.tobytes()
    for i, x in zip(at, logs):
        p = brute_prob(counts, contexts, raw[i - st.DEPTH:i], raw[i])
        assert x == pytest.approx(math.log10(p))
    # Every state is a distribution over the symbols.
    for context in (b"\x0b\x0bxyz", b"a the", b"\x0b\x0b\x0bat"):
        keys = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert (10 ** tree.log10(keys)).sum() == pytest.approx(1)


def test_states_pass_the_divergence_test(spark):
    """One symbol before decides here, so one is kept and never two."""
    from gleanery.llm.common import Scratch

    # "q" is always followed by "u"; otherwise letters are independent.
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh"), 60_000))
    text = text.replace("a", "qu")
    stream, _ = stream_of([text])
    values, n = np.unique(st.packed(stream, np.flatnonzero(stream != st.PAD)), return_counts=True)
    grams = spark.createDataFrame(
        list(zip(values.view(np.int64).tolist(), n.tolist())), "key bigint, n bigint")
    tree = st.fit_tree(grams, Scratch(spark, "test"))
    kept = {int(k) for k, i in zip(tree.states[0][0].keys, tree.states[0][0].index) if i >= 0}
    assert ord("q") in kept
    assert not any((tree.states[k][0].index >= 0).any() for k in range(1, st.DEPTH))


def test_base_score_is_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    counts = Counter()
    for i, w in texts.items():
        if not held(i):
            counts.update([*w, None])
    total, kinds = sum(counts.values()), len(counts)
    rows = st.score_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens = [*texts[r["doc_id"]], None]
        assert r["held_out"] == held(r["doc_id"])
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), total)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert r["base_score"] == pytest.approx(
            sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens))
        assert -1e9 < r["score"] < 0


def test_rare_words_are_joined(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    whole = {r["doc_id"]: r for r in st.score_documents(docs).collect()}
    monkeypatch.setattr(st, "MAX_FREQUENT", 10)
    for r in st.score_documents(docs).collect():
        assert r["n_known"] == whole[r["doc_id"]]["n_known"]
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"])


def test_rare_states_are_joined(spark, monkeypatch):
    """Scores are the same however little of the tree is broadcast."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    whole = {r["doc_id"]: r["score"] for r in st.score_documents(docs).collect()}
    monkeypatch.setattr(st, "LEAST_SHARE", 1e-2)
    for r in st.score_documents(docs).collect():
        assert r["score"] == pytest.approx(whole[r["doc_id"]])


def test_odd_rows(spark, documents):
    text = "some words of a text that goes on "
    rows = [(i, text * 5, None, None) for i in range(30)] + [
        (100, None, None, None), (101, "", None, None), (None, "a b", None, None),
        (103, text * 40_000, None, None), (0, text * 5, None, None)]
    found = st.score_documents(documents([(*r, 1.0) for r in rows], ", score double")).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[100]["n_tokens"] == by[101]["n_tokens"] == 1
    assert by[100]["score"] == by[101]["score"] < 0 and not by[None]["held_out"]
    assert by[103]["n_tokens"] == 320_001
    # Learned text is likelier than strange text.
    assert by[0]["score"] / by[0]["n_tokens"] > by[None]["score"] / by[None]["n_tokens"]
    assert st.score_documents(documents([])).collect() == []
    held_only = [(i, "x y", None, None) for i in range(200) if held(i)]
    alone = st.score_documents(documents(held_only)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in alone)


def test_symbols_that_come_again_are_looked_up_once():
    from types import SimpleNamespace

    class Counted:
        asked = []

        def log10(self, keys, lengths):
            self.asked.append(len(keys))
            return -(keys & np.uint64(7)).astype(float)

    texts = ["abc abc " * 500, None, "abc"]
    frequent = st.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    nowhere = np.zeros(1 << (st.MAP_BITS - 3), np.uint8)
    run = st._score(*(SimpleNamespace(value=v) for v in (Counted(), frequent, nowhere)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "held_out": [False] * 3, "text": texts})
    scores = next(run([batch])).column("score").to_pylist()
    assert scores == [-sum(b & 7 for b in written(t)) for t in texts]
    assert sum(Counted.asked) < 30


@pytest.mark.parametrize("limits", [{}, {"BLOCK_SYMBOLS": 1}, {"BLOCK_TEXTS": 2}, {"BLOCK_KEYS": 3}])
def test_texts_ask_together_for_what_is_not_in_the_tree(monkeypatch, limits):
    """Once for a symbol that many texts have; what comes back is theirs, as often as they have it."""
    from types import SimpleNamespace

    for name, value in limits.items():
        monkeypatch.setattr(st, name, value)

    class Empty:
        def log10(self, keys, lengths):
            return np.zeros(len(keys))

    texts = ["abc abc abd " * 40, None, "abc", "", "abc abc abd " * 40, "x" * 300_000] * 3
    frequent = st.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    everywhere = np.full(1 << (st.MAP_BITS - 3), 255, np.uint8)
    run = st._score(*(SimpleNamespace(value=v) for v in (Empty(), frequent, everywhere)))
    batches = [pa.RecordBatch.from_pydict({
        "doc_id": list(range(i, i + 6)), "held_out": [False] * 6, "text": texts[i:i + 6]})
        for i in range(0, len(texts), 6)]
    found = pa.Table.from_batches(list(run(batches)))
    ids = {r["row"]: r["doc_id"] for r in found.to_pylist() if r["block"] is None}
    assert list(ids.items()) == [(i, i) for i in range(len(texts))]
    asked, sums = Counter(), Counter()
    blocks = found.filter(pc.is_valid(found.column("block")))
    for block in pc.unique(blocks.column("block")).to_pylist():
        rows = blocks.filter(pc.equal(blocks.column("block"), block))
        keys = rows.column("keys").combine_chunks().flatten().to_numpy()
        assert len(np.unique(keys)) == len(keys)
        asked.update(keys.tolist())
        values = pa.table({"key": keys[::-1], "log10": -(keys[::-1] & 7).astype(float) - 1})
        for r in st.block_sums(rows, values).to_pylist():
            assert r["row"] not in sums
            sums[r["row"]] = r["late"]
    assert sums == {i: -sum((b & 7) + 1 for b in written(t)) for i, t in enumerate(texts)}
    if not limits or "BLOCK_KEYS" in limits:
        assert set(asked.values()) == {1}
