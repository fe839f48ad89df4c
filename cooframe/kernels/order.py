"""Orderings of one matrix in one task."""

from __future__ import annotations

import numpy as np


def reverse_cuthill_mckee(row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """Nodes from the last visited to the first: breadth first from a node of least degree, neighbours by degree."""
    keep = row != col
    r, c = np.concatenate([row[keep], col[keep]]), np.concatenate([col[keep], row[keep]])
    code = np.unique(r * n + c)
    r, c = code // n, code % n
    start = np.searchsorted(r, np.arange(n + 1))
    degree = np.diff(start)
    seen = np.zeros(n, bool)
    out: list[int] = []
    for seed in np.argsort(degree, kind="stable").tolist():
        if seen[seed]:
            continue
        seen[seed] = True
        queue = [seed]
        for v in queue:
            near = c[start[v] : start[v + 1]]
            near = near[~seen[near]]
            near = near[np.argsort(degree[near], kind="stable")]
            seen[near] = True
            queue += near.tolist()
        out += queue
    return np.array(out[::-1], np.int64)
