"""Products of blocks of sparse matrices in NumPy, a bounded number of terms at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Terms that are laid out at once.
TERMS = 1 << 18  # so many stay in a core's cache


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of sorted ``keys``, where each begins and how often it stands."""
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], new, np.diff(np.append(new, len(keys)))


def _found(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted distinct values ``among``, and whether they are there."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def _laid_out(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places in another table of all terms of spans of it."""
    done = np.cumsum(count)
    return np.arange(done[-1] if len(done) else 0) + np.repeat(first - (done - count), count)


def _groups(rows: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted ``rows`` cut where a row ends, with about TERMS terms each: begin, end, and pieces of it that have no more, one entry apart."""
    _, begin, length = _spans(rows)
    done = np.append(0, np.cumsum(count))
    ends = begin + length
    k = 0
    while k < len(begin):
        last = max(k + 1, int(np.searchsorted(done[ends], done[begin[k]] + TERMS, "right")))
        lo, hi = int(begin[k]), int(ends[last - 1])
        pieces, at = [], lo
        while at < hi:
            to = min(hi, max(at + 1, int(np.searchsorted(done, done[at] + TERMS, "right")) - 1))
            pieces.append((at, to))
            at = to
        yield lo, hi, pieces
        k = last


def multiply(x: tuple, y: tuple) -> Iterator[tuple[np.ndarray, ...]]:
    """``row, col, val, known`` of X Y, rows of X one group after another.

    A factor is (row, col, val, known); a term with an unknown value adds
    nothing, and a place that has no others is unknown.
    """
    xr, xk, xv, xo = x
    yk, yc, yv, yo = (a[np.argsort(y[0], kind="stable")] for a in y)
    ks, first, count = _spans(yk)
    at, there = _found(ks, xk)
    order = np.flatnonzero(there)
    order = order[np.argsort(xr[order], kind="stable")]
    xr, xv, xo, at = xr[order], xv[order], xo[order], at[order]
    first, count = first[at], count[at]
    cols, yc = np.unique(yc, return_inverse=True)
    plain = bool(xo.all() and yo.all())
    for lo, hi, pieces in _groups(xr, count):
        rows, local = np.unique(xr[lo:hi], return_inverse=True)
        cells, terms = len(rows) * len(cols), int(count[lo:hi].sum())
        dense = cells <= 4 * terms or len(pieces) > 1
        total = np.zeros(cells) if dense else None
        seen, known = (np.zeros(cells, bool), np.zeros(cells, bool)) if dense else (None, None)
        for a, b in pieces:
            place = _laid_out(first[a:b], count[a:b])
            key = np.repeat(local[a - lo : b - lo] * len(cols), count[a:b]) + yc[place]
            value = np.repeat(xv[a:b], count[a:b]) * yv[place]
            fine = None if plain else np.repeat(xo[a:b], count[a:b]) & yo[place]
            if not plain:
                value = np.where(fine, value, 0.0)
            if dense:
                total += np.bincount(key, value, cells)
                seen[key] = True
                if not plain:
                    known[key[fine]] = True
            else:
                key, inverse = np.unique(key, return_inverse=True)
                total = np.bincount(inverse, value, len(key))
                known = np.ones(len(key), bool) if plain else np.bincount(inverse, fine, len(key)) > 0
        if dense:
            key = np.flatnonzero(seen)
            total, known = total[key], np.ones(len(key), bool) if plain else known[key]
        yield rows[key // max(1, len(cols))], cols[key % max(1, len(cols))], total, known


def multiply_at(pr: np.ndarray, pc: np.ndarray, x: tuple, y: tuple) -> Iterator[tuple[np.ndarray, ...]]:
    """``row, col, val`` of X Y at the places ``pr, pc`` alone; zero where no term is known."""
    order = np.argsort(pr, kind="stable")
    pr, pc = pr[order], pc[order]
    order = np.lexsort((x[1], x[0]))
    order = order[x[3][order]]
    xr, xk, xv = x[0][order], x[1][order], x[2][order]
    ks, xk = np.unique(xk, return_inverse=True)
    at, there = _found(ks, y[0])
    there &= y[3]
    yk, yc, yv = at[there], y[1][there], y[2][there]
    order = np.argsort(yc, kind="stable")
    yk, yc, yv = yk[order], yc[order], yv[order]
    cs, first, count = _spans(yc)
    at, there = _found(cs, pc)
    first, count = (first[at], np.where(there, count[at], 0)) if len(cs) else (np.zeros(len(pc), np.int64),) * 2
    finite = bool(np.isfinite(yv).all())
    for lo, hi, pieces in _groups(pr, count):
        rows, local = np.unique(pr[lo:hi], return_inverse=True)
        a, b = np.searchsorted(xr, rows[0]), np.searchsorted(xr, rows[-1], "right")
        row, there = _found(rows, xr[a:b])
        have = (row * len(ks) + xk[a:b])[there]  # ascending, each once
        value = xv[a:b][there]
        slab = None
        if finite and len(rows) * len(ks) <= 4 * max(TERMS, len(have)):
            slab = np.zeros(len(rows) * len(ks))  # a value that is absent adds 0 to what is finite
            slab[have] = value
        out = np.zeros(hi - lo)
        for p, q in pieces:
            place = _laid_out(first[p:q], count[p:q])
            key = np.repeat(local[p - lo : q - lo] * len(ks), count[p:q]) + yk[place]
            if slab is not None:
                term = slab[key] * yv[place]
            else:
                at, fine = _found(have, key)
                term = np.zeros(len(key))
                term[fine] = value[at[fine]] * yv[place[fine]]
            some = np.flatnonzero(count[p:q])
            if len(some):
                begin = (np.cumsum(count[p:q]) - count[p:q])[some]
                out[p - lo + some] = np.add.reduceat(term, begin) + 0.0
        yield pr[lo:hi], pc[lo:hi], out
