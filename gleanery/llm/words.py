"""Words of many texts at once as 64-bit hashes, by array arithmetic.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; A-Z count as
a-z.  The hash of a word is a polynomial over its bytes modulo 2^64, taken
from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are worked on in pieces of about this many bytes.
PIECE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + (PIECE >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def hash_piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of ``data`` (uint8); a word also
    ends where a text begins (``breaks``)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    first[breaks[breaks < n]] = True
    starts = np.flatnonzero(inside & first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~inside[1:] | first[1:]
    ends = np.flatnonzero(inside & last) + 1
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, cut at spaces."""
    found, at, n = [], 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        while end < n:
            gap = np.flatnonzero(SPACE[data[end:end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + PIECE, n)
        found.append(hash_piece(data[at:end], np.empty(0, np.int64))[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][:len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of consecutive texts of up to ``size`` bytes; a longer text
    is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, bounds): the words of texts i to j - 1 of the column, those
    of text k are hashes[bounds[k - i]:bounds[k - i + 1]]."""
    data, offsets = raw_texts(column)
    for i, j in pieces(offsets):
        low, high = int(offsets[i]), int(offsets[j])
        if j == i + 1 and high - low > PIECE:
            hashes = _long(data[low:high])
            yield i, j, hashes, np.array([0, len(hashes)])
            continue
        own = offsets[i:j + 1] - low
        hashes, starts = hash_piece(data[low:high], own[:-1])
        yield i, j, hashes, np.searchsorted(starts, own)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + hashes[i:n - width + 1 + i])
    return total
