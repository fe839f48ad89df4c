"""Vectorised hashing of words and word shingles, shared by the document operators.

Words are runs of characters other than space and U+0009 to U+000D, after A-Z
are lower-cased; both rules touch single bytes of UTF-8 only, so the work is
done on bytes. Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(71).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLICE = 1 << 18
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * _SLICE)
        forward = np.full(size, _BASE, np.uint64)
        back = np.full(size, _INVERSE, np.uint64)
        forward[0] = back[0] = 1
        _powers[:] = [np.cumprod(forward), np.cumprod(back)]
    return _powers[0], _powers[1]


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``blob``, a slice at a time; slices end at gaps."""
    hashes, firsts, at = [], [], 0
    while at < len(blob):
        end = at + _SLICE
        if end < len(blob):
            gap = _GAP.search(blob, end)
            end = gap.start() if gap else len(blob)
        part = np.frombuffer(blob, np.uint8, min(end, len(blob)) - at, at)
        word = _IS_WORD[part]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            forward, back = _power_tables(len(part) + 1)
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_LETTERS[part] * forward[: len(part)], out=total[1:])
            hashes.append(mix((total[ends] - total[starts]) * back[starts]))
            firsts.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def shingles(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    A text with fewer words has the whole sequence as its one shingle; a text
    that is null or has no word has none.
    """
    blobs = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    words, firsts = word_hashes(b"\n".join(blobs))
    bounds = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in blobs], out=bounds[1:])
    cut = np.searchsorted(firsts, bounds)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _STEPS[k]
    mix(rolled)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.array([(words[a:b] * _STEPS[: b - a]).sum() + np.uint64(b - a)], np.uint64)
            out.append(mix(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def in_groups(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; one larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
