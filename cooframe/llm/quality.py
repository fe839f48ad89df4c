"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model learns from, in expectation.
SAMPLE = 20_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.15, 6, 8, 40
FEATURES = "chars words word_length upper digit symbol marks bang pipe lines distinct caps marked ends line_copies triple_copies short non_ascii edge_symbols entropy".split()
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_MARKS = b"*$&%#"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def features(text: str | None) -> list[float]:
    """Measures of a whole text, all zero where it is null or empty."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    count = lambda chars: n - len(raw.translate(None, chars))
    upper, lower, digit, symbol, marks = count(_UPPER), count(_LOWER), count(_DIGIT), count(_SYMBOL), count(_MARKS)
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    triples = list(zip(words, words[1:], words[2:]))
    tails = [w[-1] for w in words]
    spread = [raw.count(c) for c in b"etaoinshr .,\n!|*#"]
    spread.append(max(0, n - sum(spread)))
    entropy = -sum(c / n * math.log(c / n) for c in spread if c)
    return [
        math.log1p(len(text)), math.log1p(len(words)), len(text) / k, upper / max(1, upper + lower), digit / n, symbol / n, marks / n, raw.count(b"!") / k, raw.count(b"|") / k, len(lines) / k,
        len(set(words)) / k, sum(map(str.isupper, words)) / k, sum(t in "*$&%#" for t in tails) / k, sum(t in ".!?" for t in tails) / k, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(triples)) / max(1, len(triples)),
        sum(len(w) < 3 for w in words) / k, (n - len(text)) / n, sum(t in "*$&%#!|" for t in tails) / k, entropy,
    ]


@dataclass
class Model:
    """Sum of lookup tables: one for each feature and one for each chosen pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edge, x[:, f], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(edge, x[:, f], side="right") for f, edge in enumerate(self.pair_edges)]
            for (a, b), table in zip(self.pairs, self.pair_tables):
                z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.empty(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin for the best tree of ``depth`` levels over one feature's bins."""
    value = g.sum() / (h.sum() + 1.0)
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
        gains[(ch < 1e-3) | (h.sum() - ch < 1e-3)] = -1
        at = int(gains.argmax())
        if gains[at] > 1e-9:
            return np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1), _tree(g[at + 1 :], h[at + 1 :], depth - 1)])
    return np.full(len(g), value)


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best pair of cuts of a two-way table: its gain and the four leaf values spread over the cells."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best, out = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, out
    q = []
    for c in (cg, ch):
        top = c[:-1, :-1]
        q.append((top, c[:-1, -1:] - top, c[-1:, :-1] - top, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + top))
    gains = sum(_gain(x, y) for x, y in zip(*q)) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    values = [x[i, j] / (y[i, j] + 1.0) for x, y in zip(*q)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gains[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost shallow trees feature by feature in turn, then over the pairs that gain most on what is left."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = math.log(share / (1 - share))
    n = x.shape[1]
    edges = [_edges(x[:, f], BINS) for f in range(n)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, tables)
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(n)]
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f in range(n):
            p = 1 / (1 + np.exp(-z))
            size = len(tables[f])
            step = RATE * _tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size), 2)
            tables[f] += step
            z += step[bins[f]]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(n)]
    coarse = [np.searchsorted(model.pair_edges[f], x[:, f], side="right") for f in range(n)]

    def table(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
        shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        cell = coarse[a] * shape[1] + coarse[b]
        p = 1 / (1 + np.exp(-z))
        size = shape[0] * shape[1]
        return np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape), cell, shape

    gains = sorted(((-_quadrants(*table(a, b)[:2])[0], a, b) for a in range(n) for b in range(a)))[:PAIRS]
    model.pairs = [(a, b) for _, a, b in gains]
    model.pair_tables = [np.zeros(table(a, b)[3]) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h, cell, _ = table(a, b)
            step = RATE * _quadrants(g, h)[1]
            model.pair_tables[k] += step
            z += step.ravel()[cell]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, eligible, sample: int = SAMPLE) -> Model:
    """Learn from texts of ``docs`` and ``labels`` (doc_id, quality) whose doc_id passes the column ``eligible``.

    Of the labelled rows a share chosen by a hash of doc_id is used, of
    ``sample`` rows in expectation; that many features and no text come to the
    driver. Null labels count for nothing; of several labels for one doc_id the
    mean counts. With no label, or one class only, all scores equal its share.
    """
    rows = labels.where(eligible & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    count = rows.count()
    if count > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample / count))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # labels: at most ``sample`` pairs of numbers, whatever the input
    joined = texts.join(F.broadcast(rows), "doc_id").select("doc_id", "text", "quality")
    found = joined.mapInArrow(_measured, "doc_id long, quality double, x array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    return train(x, np.array([float(r["quality"] >= 0.5) for r in found]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) for every row of ``docs`` (doc_id, text), from the text alone; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
