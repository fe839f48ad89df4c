"""Connected components of a task's edges in NumPy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Edges that a task holds at once.
EDGES = 1 << 21


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the edges (a, b), once, and the least end that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = root[low], root[high]
        apart = low != high
        if not apart.any():
            return nodes, nodes[root]
        low, high = low[apart], high[apart]
        np.minimum.at(root, np.maximum(low, high), np.minimum(low, high))
        while not np.array_equal(up := root[root], root):
            root = up


def joined(edges: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``stars`` of a stream of edges, of all of it where its nodes are at most half of EDGES, else of stretches of it."""
    held, size = [], 0

    def settle():
        return stars(*(np.concatenate(x) for x in zip(*held)))

    for pair in edges:
        held.append(pair)
        size += len(pair[0])
        if size >= EDGES:
            held = [settle()]
            size = len(held[0][0])
            if size > EDGES // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield settle()
