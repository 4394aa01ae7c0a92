"""BK-trees over 64-bit fingerprints, as flat arrays, for many shards at a time.

A child hangs below its parent on an edge that carries their Hamming distance.  A search with
radius r at a node of distance d follows only the edges d - r to d + r.  Building and searching
work level by level on whole arrays, so a shard of one fingerprint costs next to nothing and a
shard of thousands stays vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EDGES = 65


class Forest:
    """One tree per shard; ``shard`` must be sorted and fingerprints distinct within a shard."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        n = len(prints)
        self.prints = prints
        new = np.ones(n, bool)
        new[1:] = shard[1:] != shard[:-1]
        roots = np.flatnonzero(new)
        self.root = roots[np.cumsum(new) - 1] if n else roots
        self.starts = roots
        keys, children = [], []
        waiting = np.flatnonzero(~new)
        at = self.root[waiting]
        while len(waiting):
            edge = at * EDGES + np.bitwise_count(prints[waiting] ^ prints[at])
            taken, first, which = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(taken)
            children.append(waiting[first])
            settled = np.zeros(len(waiting), bool)
            settled[first] = True
            at = waiting[first][which][~settled]
            waiting = waiting[~settled]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    def search(
        self, prints: np.ndarray, roots: np.ndarray, radius: int, block: int = 2048
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, by blocks of queries."""
        for first in range(0, len(prints), block):
            query = np.arange(first, min(first + block, len(prints)))
            node = roots[query]
            while len(query):
                distance = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
                near = distance <= radius
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.keys, node * EDGES + np.maximum(distance - radius, 0))
                high = np.searchsorted(
                    self.keys, node * EDGES + np.minimum(distance + radius, EDGES - 1), "right"
                )
                fan = high - low
                total = int(fan.sum())
                ahead = np.repeat(low - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan)
                node = self.children[ahead + np.arange(total)]
                query = np.repeat(query, fan)


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` after joining the classes of each pair; a class bears its smallest label."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
        if np.array_equal(before, labels):
            return labels
