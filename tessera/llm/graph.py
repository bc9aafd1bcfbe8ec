"""Spanning forests inside a block; components of all links come from the library."""

from __future__ import annotations

import numpy as np

from ..operators.graph import connected_components

__all__ = ["Forest", "connected_components"]


class Forest:
    """Union-find over 0..n-1 that keeps only links which join two trees.

    add() takes arrays of links and returns the indices of the spanning ones, so a
    block of n rows never emits more than n - 1 links however many pairs match.
    """

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        kept = []
        idx = np.flatnonzero(self.root[i] != self.root[j])
        while len(idx):
            # One link per tree on the j side in each round; then trees are merged and links inside a tree fall away.
            _, first = np.unique(self.root[j[idx]], return_index=True)
            for k in idx[first]:
                a, b = self.find(self.root[i[k]]), self.find(self.root[j[k]])
                if a != b:
                    self.root[max(a, b)] = min(a, b)
                    kept.append(k)
            self.flatten()
            idx = idx[self.root[i[idx]] != self.root[j[idx]]]
        return np.array(kept, dtype=np.int64)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up
