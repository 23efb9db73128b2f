import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from gleanery.llm import prefix_trie
from gleanery.llm.double_array import FREE, DoubleArray

TURNS = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return whole


def brute(rows):
    """Rows of all nodes, sorted."""
    members, ending = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(c)
        ending[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[c] for c in below)
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else -1, len(members[n]),
                   len(children[n]), leaves[n], saved[n],
                   sha256(",".join(map(str, sorted(ending[n]))).encode()).hexdigest())
                  for n in members)


def got(spark, rows, partitions=3, more="", extra=()):
    frame = spark.createDataFrame([(*r, *extra) for r in rows], TURNS + more)
    found = prefix_trie.prefix_nodes(frame.repartition(partitions)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256").collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in found)


def made(seed, n, turns=9, texts=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if t > 1 else "user",
             f"Ä{rng.randrange(texts)}" * (1 + t % 3))
            for c in rng.sample(range(3 * n), n) for t in range(rng.randrange(1, turns))]


def test_brute_force(spark):
    rows = made(1, 250)
    rows += [(5000 + i, t, "user", f"same {t}") for i in range(120) for t in range(4)]
    rows += [(-250, 0, "user", "below zero"), (-200, 0, "user", "x"), (-200, 1, None, None)]
    rows += [(7000, None, "user", "first"), (7000, 3, "", ""), (7000, 5, None, "last")]
    assert got(spark, rows) == brute(rows)


def test_small_shards_and_bands(spark, monkeypatch):
    """Nodes that many shards have, and paths through many bands."""
    monkeypatch.setattr(prefix_trie, "SHARD", 7)
    monkeypatch.setattr(prefix_trie, "BAND", 3)
    rows = made(2, 80, turns=14, texts=2)
    assert got(spark, rows) == brute(rows)


def test_a_very_long_conversation_and_a_hot_opening(spark):
    rows = [(100, t, "user", f"turn {t % 11}") for t in range(1500)]
    rows += [(100 + i, t, "user", "hello" if t < 7 else f"own {i}")
             for i in range(1, 100) for t in range(8)]
    rows += [(900 + i, t, "user", f"turn {t % 11}") for i in range(2) for t in range(700)]
    assert got(spark, rows) == brute(rows)


def test_turnless_conversations_and_ties(spark):
    """Conversations shorter than their opening, without a base, have no turn."""
    rows = [(c, 0, "user", "only") for c in range(101, 140)]
    found = got(spark, rows)
    assert found == brute(rows) and max(r[3] for r in found if r[1] == 0) == 39
    silent = [c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6][0]
    assert got(spark, [(silent, 0, "user", "x")]) == brute([(silent, 0, "user", "x")])
    # Rows of equal number keep one order, however they are dealt.
    ties = [(300, 0, "user", f"t{i}") for i in range(6)] + [(300, 0, "user", "t1")] * 2
    assert got(spark, ties, 1) == got(spark, ties, 5)


def test_empty_table_null_ids_long_text_and_clashing_columns(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x"), (None, None, None, None)]) == []
    rows = [(1, 0, "user", "long " * 400_000), (2, 0, "user", "y"), (2, 1, None, "z")]
    assert got(spark, rows, more=", a string, depth double, block string",
               extra=("x", 1.0, "y")) == brute(rows)


@pytest.mark.parametrize("seed", range(8))
def test_double_array_holds_just_its_paths(seed):
    rng = np.random.default_rng(seed)
    paths = np.zeros((60, 6), np.int64)
    for i, n in enumerate(rng.integers(0, 7, 60)):
        paths[i, :n] = rng.integers(1, rng.integers(2, 40), n)
    trie = DoubleArray(paths)
    names = {}
    for path, states in zip(paths, trie.states):
        at = 0
        for depth in range(6):
            if not path[depth]:
                assert (states[depth:] == FREE).all()
                break
            assert trie.check[states[depth]] == at
            assert trie.base[at] + path[depth] == states[depth]
            at = states[depth]
            assert names.setdefault(at, tuple(path[:depth + 1])) == tuple(path[:depth + 1])
    assert len(names) == len({tuple(p[:d]) for p in paths for d in range(1, 7) if p[d - 1]})
    assert (trie.check != FREE).sum() == len(names) + 1
    with pytest.raises((KeyError, IndexError)):
        trie.traverse(np.array([[41]]))


def test_subtree_sums():
    """States 1 and 2 below the root 0, 3 below 2, 4 free, 5 below 3."""
    check = np.array([0, 0, 0, 2, FREE, 3])
    depth = np.array([0, 1, 1, 2, 0, 3])
    values = np.array([[0, 0], [1, 10], [2, 20], [3, 30], [0, 0], [5, 50]])
    sums = prefix_trie.subtree_sums(check, depth, values)
    assert sums[:, 0].tolist() == [0, 1, 10, 8, 0, 5]
    assert sums[:, 1].tolist() == [0, 10, 100, 80, 0, 50]
