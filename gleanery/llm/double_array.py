"""A double-array trie: the child of state s by label c is t = BASE[s] + c, if
CHECK[t] = s."""

from __future__ import annotations

import numpy as np

FREE = -1


class DoubleArray:
    """The trie of ``paths``, rows of labels from 1 on, filled up with 0.

    State 0 is the root.  ``states[i, d]`` is the state of row i behind its label d,
    -1 if the row is shorter.
    """

    def __init__(self, paths: np.ndarray):
        self._next_free = np.arange(int(paths.max(initial=0)) + paths.size + 2)
        self.base = np.zeros(len(self._next_free), np.int64)
        self.check = np.full(len(self._next_free), FREE, np.int64)
        self._take(0, 0)
        self._build(paths)
        size = int(np.flatnonzero(self.check != FREE).max(initial=0)) + 1
        self.base, self.check = self.base[:size], self.check[:size]
        self.states = self.traverse(paths)

    def _free(self, slot: int) -> int:
        """The first free slot from ``slot`` on."""
        found = slot
        while found < len(self._next_free) and self._next_free[found] != found:
            found = int(self._next_free[found])
        if found >= len(self._next_free):
            self._grow(found + 1)
        while slot != found:
            after = int(self._next_free[slot])
            self._next_free[slot] = found
            slot = after
        return found

    def _grow(self, size: int) -> None:
        old = len(self._next_free)
        more = max(size, 2 * old) - old
        self._next_free = np.concatenate([self._next_free, np.arange(old, old + more)])
        self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
        self.check = np.concatenate([self.check, np.full(more, FREE, np.int64)])

    def _take(self, slot: int, parent: int) -> None:
        self.check[slot] = parent
        self._next_free[slot] = slot + 1

    def _place(self, labels: np.ndarray) -> int:
        """The least base, by its first child, at which all children are free."""
        slot = int(labels[0])
        while True:
            slot = self._free(slot)
            base = slot - int(labels[0])
            if base + int(labels[-1]) >= len(self.check):
                self._grow(base + int(labels[-1]) + 1)
            if (self.check[base + labels] == FREE).all():
                return base
            slot += 1

    def _build(self, paths: np.ndarray) -> None:
        if not paths.size:
            return
        rows = np.unique(paths, axis=0)
        # Whether a row differs from the one before within its first d + 1 labels.
        new = np.ones(rows.shape, bool)
        new[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
        parents = np.zeros(len(rows), np.int64)
        for depth in range(rows.shape[1]):
            live = np.flatnonzero(rows[:, depth] > 0)
            if not len(live):
                return
            first = live[new[live, depth]]
            # Children of one parent stand together, their labels ascending.
            starts = np.flatnonzero(np.diff(parents[first], prepend=-1))
            for low, high in zip(starts, [*starts[1:], len(first)]):
                parent, labels = int(parents[first[low]]), rows[first[low:high], depth]
                base = self._place(labels)
                self.base[parent] = base
                for label in labels:
                    self._take(base + int(label), parent)
            parents[live] = self.base[parents[live]] + rows[live, depth]

    def traverse(self, paths: np.ndarray) -> np.ndarray:
        """The states of ``paths``; -1 behind their ends."""
        states = np.full(paths.shape, FREE, np.int64)
        at = np.zeros(len(paths), np.int64)
        for depth in range(paths.shape[1]):
            live = np.flatnonzero(paths[:, depth] > 0)
            found = self.base[at[live]] + paths[live, depth]
            if (self.check[found] != at[live]).any():
                raise KeyError("a path that the trie has not got")
            at[live] = states[live, depth] = found
        return states
