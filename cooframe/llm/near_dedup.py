"""Near-duplicates by MinHash: banded universal hash minima, confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import in_groups, mix, shingles
from .components import connected_components
from .shared import spread, written

BANDS, ROWS = 24, 4
#: A group of candidates within both bounds is confirmed in one task; larger ones bucket by bucket, in blocks.
GROUP_DOCS, GROUP_SHINGLES, BLOCK = 2000, 4_000_000, 256
_CHARS = 1 << 20


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4242)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each universal hash ``a * x + b`` over a set."""
    out = np.full(len(a), np.uint64(2**64 - 1))
    for s in range(0, len(hashes), 1024):
        np.minimum(out, (a[:, None] * hashes[s : s + 1024] + b[:, None]).min(1), out=out)
    return out


def band_keys(minima_: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of minima; keys of different bands do not meet."""
    step = np.random.default_rng(99).integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mix((minima_.reshape(bands, rows) * step).sum(1) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketcher(width: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for s, e in in_groups([len(t or "") for t in texts], _CHARS):
                sets = shingles(texts[s:e], width)
                keys = [band_keys(minima(x, a, b), bands, rows).view(np.int64) if len(x) else None for x in sets]
                same = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "same", "bands"])

    return sketch


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(ids: list[int], sides: list[int], texts: list[str], width: int, percent: int, bands: int, rows: int) -> list[tuple[int, int]]:
    """Links that join the documents of one group into its components.

    First each bucket's documents are compared with its first one; then, bucket
    by bucket, every pair that is not yet joined. A pair is compared on the
    whole sets unless the sizes rule it out or its minima agree so seldom that
    a similarity at the threshold lies six deviations off. Where ``sides``
    differ within a group, only pairs across the two sides are compared.
    """
    sets: list[np.ndarray] = []
    for s, e in in_groups([len(t) for t in texts], _CHARS):
        sets += shingles(texts[s:e], width)
    a, b = _coefficients(bands * rows)
    signature = np.stack([minima(x, a, b) for x in sets])
    keys = np.stack([band_keys(x, bands, rows) for x in signature])
    size, side = np.array([len(x) for x in sets]), np.array(sides)
    one_side = len(set(sides)) == 1
    share = percent / 100
    agree = int(bands * rows * max(0.0, share - 6 * (share * (1 - share) / (bands * rows)) ** 0.5))
    runs = []
    for band in range(bands):
        order = np.argsort(keys[:, band], kind="stable")
        runs += [np.sort(r) for r in np.split(order, np.flatnonzero(np.diff(keys[order, band])) + 1) if len(r) > 1]
    root, tried, out = list(range(len(ids))), set(), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def compare(i: int, others: np.ndarray) -> None:
        able = 100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others])
        if not one_side:
            able &= side[i] != side[others]
        others = others[able]
        for j in others[(signature[others] == signature[i]).sum(1) >= agree].tolist():
            p, q = find(i), find(j)
            if p != q and (i, j) not in tried:
                tried.add((i, j))
                if _alike(sets[i], sets[j], percent):
                    root[max(p, q)] = min(p, q)
                    if ids[i] != ids[j]:
                        out.append((ids[i], ids[j]))

    for run in runs:
        compare(int(run[0]), run[1:])
    for run in runs:
        for k, i in enumerate(run[:-1].tolist()):
            roots = np.array([find(j) for j in run[k:].tolist()])
            rest = run[k + 1 :][roots[1:] != roots[0]]
            if len(rest):
                compare(i, rest)
            elif (roots == roots[0]).all():
                break
    return out


def _confirmer(width: int, percent: int, bands: int, rows: int):
    """Over rows (key, doc_id, side, text) sorted by key: the links within each key."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, texts = None, [], [], []

        def close() -> list[tuple[int, int]]:
            return _links(ids, sides, texts, width, percent, bands, rows) if len(ids) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for k, i, side, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if k != key:
                    out += close()
                    key, ids, sides, texts = k, [], [], []
                ids.append(i)
                sides.append(side)
                texts.append(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return confirm


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of ``width``-word shingles. ``component_id`` is the least doc_id that
    links reach, itself included; ``kept`` says doc_id = component_id.

    Copies with equal sets become one class before any comparison. Classes
    that share a band key of four minima are candidates: at a similarity of
    0.8 a pair shares none of the 24 bands with a probability of 3e-6. Groups
    of candidates are made by components over bucket hubs, never as pairs; each
    group's texts meet in one task, or, where a group is large, bucket by
    bucket in pairs of blocks, so that no task grows with a group and no pair
    is given up. Candidates are confirmed on their whole sets.

    Null and wordless texts have 0 shingles and no link. Rows with one doc_id
    are one node. A null doc_id is linked with nothing: its component_id is
    null and it is kept. Other columns are ignored. An empty table gives an
    empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = spread(docs)
    sketch = written(docs.mapInArrow(_sketcher(width, bands, rows), "doc_id long, n_shingles long, same binary, bands array<long>"), "sketch")
    known = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = written(known.groupBy("same").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("docs")).where("docs > 1")
    shares = written(keyed.join(buckets, "bucket"), "buckets")
    groups = connected_components(shares.where("node <> hub").select("node", "hub").distinct(), "node", "hub")
    groups = written(groups.join(classes.groupBy("node").agg(F.sum("size").alias("size")), "node"), "groups")
    totals = groups.groupBy("root").agg(F.count("*").alias("docs"), F.sum("size").alias("shingles"))
    small = (F.col("docs") <= GROUP_DOCS) & (F.col("shingles") <= GROUP_SHINGLES)
    sized = written(groups.join(totals, "root").withColumn("small", small), "groups")
    places = sized.where("small").select(F.col("node"), F.struct(F.col("root").alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("key"), F.lit(0).alias("side"))
    if not sized.where("not small").isEmpty():
        places = places.union(_blocks(shares, sized.where("not small").select("node")))
    texts = docs.where("doc_id is not null").withColumnRenamed("doc_id", "node")
    rows_ = places.join(texts, "node").repartition(n, "key").sortWithinPartitions("key", "node").select(F.concat_ws("/", "key.k", "key.i", "key.j").alias("key"), "node", "side", "text")
    links = written(rows_.mapInArrow(_confirmer(width, percent, bands, rows), "a long, b long"), "links")
    roots = connected_components(links)
    classes = classes.select("same", "node").join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component"))
    out = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(classes, "same", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _blocks(shares: DataFrame, nodes: DataFrame) -> DataFrame:
    """Places for the nodes of large groups: each bucket cut into blocks, each pair of blocks a place."""
    own = shares.join(nodes, "node").withColumn("blocks", F.ceil(F.col("docs") / BLOCK).cast("int"))
    own = own.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.struct(F.col("bucket").alias("k"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return own.select("node", key.alias("key"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side")).distinct()
