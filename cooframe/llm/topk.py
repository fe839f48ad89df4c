"""Exact top-k search by inner product with a pair of cover trees, one over queries and one over data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows that meet in one task: a block of data and a block of queries, each under a tree of its own.
DATA_BLOCK, QUERY_BLOCK = 8192, 16384
LEAF, FAN = 128, 16
#: Cells of the data, at most, and vectors that their centres are chosen from, at most.
CELLS, SAMPLE = 256, 2048
_BITS = 20
_SAFE, _LONG = float(1 << 42), float(1 << 62)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Node:
    """A node over rows ``lo`` to ``hi`` of the tree's order: its centre is one of them, ``radius`` covers them all."""

    __slots__ = ("lo", "hi", "centre", "norm", "radius", "children")

    def __init__(self, lo: int, hi: int, centre: np.ndarray, radius: float) -> None:
        self.lo, self.hi, self.centre, self.radius = lo, hi, centre, radius
        self.norm = float(np.linalg.norm(centre))
        self.children: list[Node] = []


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """Root and order of rows of a cover tree.

    A node of level i covers its rows within 2^i of its centre. Its children's
    centres are chosen farthest first until they cover its rows within
    2^(i-1), or there is one for every ``leaf`` rows, FAN at most; every row goes to its nearest centre. Rows
    that hardly split are cut into leaves as they lie.
    """
    order = np.arange(len(points))

    def build(lo: int, hi: int, centre: np.ndarray) -> Node:
        rows = points[order[lo:hi]]
        away = np.linalg.norm(rows - centre, axis=1)
        node = Node(lo, hi, centre, float(away.max()))
        if hi - lo <= leaf or node.radius == 0:
            return node
        cover = 2.0 ** (np.ceil(np.log2(node.radius)) - 1)
        near, owner, centres, most = away, np.zeros(hi - lo, np.int64), [centre], max(2, min(FAN, (hi - lo) // leaf))
        while near.max() > cover and len(centres) < most:
            centres.append(rows[int(near.argmax())])
            d = np.linalg.norm(rows - centres[-1], axis=1)
            closer = d < near
            owner[closer] = len(centres) - 1
            near = np.where(closer, d, near)
        sizes = np.bincount(owner, minlength=len(centres))
        by = np.argsort(owner, kind="stable")
        order[lo:hi] = order[lo:hi][by]
        if sizes.max() > 0.9 * (hi - lo):
            for s in range(lo, hi, leaf):
                e = min(s + leaf, hi)
                own = points[order[s]]
                node.children.append(Node(s, e, own, float(np.linalg.norm(points[order[s:e]] - own, axis=1).max())))
            return node
        at = lo
        for k, size in enumerate(sizes.tolist()):
            if size:
                node.children.append(build(at, at + size, centres[k]))
                at += size
        return node

    return build(0, len(points), points[0]), order


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, data id, score) of each query's best ``k`` rows of ``data``, which lies in ascending id order; ties to the smaller id.

    ``least``: a score for each query below which nothing is wanted.

    Pairs of nodes are visited best bound first. The bound of a pair is the
    greatest inner product that the two covering balls allow; a pair is pruned
    if it is below the worst kth score of the query node's rows so far.
    """
    low, mask = -(1 << 62), (1 << _BITS) - 1
    qroot, qorder = cover_tree(queries)
    droot, dorder = cover_tree(data)
    q, qid, d, did = queries[qorder], query_ids[qorder], data[dorder], data_ids[dorder]
    tail = mask - dorder  # of equal scores the row with the smaller id has the larger key
    best = np.full((len(q), k), low, np.int64)
    least = np.full(len(q), -np.inf) if least is None else least[qorder]
    worst = least.copy()

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return top + 1e-9 * abs(top) + 1e-6

    def compare(a: Node, b: Node) -> None:
        scores = q[a.lo : a.hi] @ d[b.lo : b.hi].T
        able = scores >= worst[a.lo : a.hi, None]
        able &= qid[a.lo : a.hi, None] != did[None, b.lo : b.hi]
        rows = np.flatnonzero(able.any(1))
        if not len(rows):
            return
        keys = np.where(able[rows], scores[rows].astype(np.int64) * (mask + 1) + tail[b.lo : b.hi], low)
        both = np.concatenate([best[a.lo + rows], keys], axis=1)
        top = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        best[a.lo + rows] = top
        last = top.min(1)
        worst[a.lo + rows] = np.where(last == low, least[a.lo + rows], np.maximum(least[a.lo + rows], last >> _BITS))

    stack = [(bound(qroot, droot), qroot, droot)]
    while stack:
        top, a, b = stack.pop()
        if top < worst[a.lo : a.hi].min():
            continue
        if not a.children and not b.children:
            compare(a, b)
            continue
        if b.children and (not a.children or b.hi - b.lo >= a.hi - a.lo):
            pairs = [(bound(a, c), a, c) for c in b.children]
        else:
            pairs = [(bound(c, b), c, b) for c in a.children]
        stack += sorted(pairs, key=lambda p: p[0])
    out = []
    for i in range(len(q)):
        for key in best[i]:
            if key != low:
                out.append((int(qid[i]), int(data_ids[mask - (int(key) & mask)]), int(key) >> _BITS))
    return out


def _scores(q: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products of one row with many, as 64-bit integers; what lies beyond them becomes the outermost one."""
    most = float(np.abs(q).max()) * float(np.abs(data).max()) * len(q)
    if most < _LONG:
        return data.astype(np.int64) @ q.astype(np.int64)
    ints = lambda row: [int(x) for x in row.tolist()]
    own = ints(q)
    return np.array([min(max(sum(x * y for x, y in zip(own, ints(d))), _LEAST), _MOST) for d in data], np.int64)


def _plain(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same by exact integers, row by row, for values beyond what floats and packed keys hold."""
    out = []
    for q, i in zip(queries, query_ids.tolist()):
        scores = _scores(q, data)
        order = np.lexsort((data_ids, ~scores))  # ~ turns the order round without overflow
        order = order[data_ids[order] != i][:k]
        out += [(i, int(data_ids[j]), int(scores[j])) for j in order]
    return out


def _block(ids: np.ndarray, asks: np.ndarray, values: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The best of one block; only pairs that a row of great values takes part in leave the trees."""
    if not asks.any() or asks.all():
        return []
    small = np.abs(values).max(1) <= np.sqrt(_SAFE / values.shape[1])
    by_id = np.argsort(ids, kind="stable")
    data, wild = by_id[(~asks & small)[by_id]], by_id[(~asks & ~small)[by_id]]
    tame, big = np.flatnonzero(asks & small), np.flatnonzero(asks & ~small)
    out: list[tuple[int, int, int]] = []
    for s in range(0, len(data), 1 << _BITS):
        if len(tame):
            d = data[s : s + (1 << _BITS)]
            out += search(values[tame], ids[tame], values[d], ids[d], k, least[tame])
    for who, whom in ((tame, wild), (big, np.concatenate([data, wild]))):
        if len(who) and len(whom):
            out += _plain(values[who], ids[who], values[whom], ids[whom], k)
    return out


def _searcher(k: int):
    """Over rows (key, vec_id, asks, x, least) sorted by key: the best of each key's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            found = _block(*(np.concatenate(c) for c in zip(*held)), k) if held else []
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if keys[s] != key:
                    yield close()
                    key, held = keys[s], []
                some = batch.slice(s, e - s)
                x = some.column(3).flatten().to_numpy(zero_copy_only=False)
                least = some.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                held.append((some.column(1).to_numpy(), some.column(2).to_numpy(zero_copy_only=False), x.reshape(e - s, -1), least))
        yield close()

    return run


def _centres(rows: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """For each length of vectors up to ``cells`` centres, farthest first from a bounded sample by hash of vec_id."""
    found = rows.orderBy(F.xxhash64("vec_id", F.lit(4))).limit(SAMPLE).select("x").collect()  # SAMPLE vectors
    out: dict[int, list[np.ndarray]] = {}
    for r in found:
        out.setdefault(len(r["x"]), []).append(np.array(r["x"]))
    for n, own in out.items():
        points = np.stack(sorted(own, key=lambda v: v.tolist()))
        chosen, near = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(cells, len(points)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(points - points[chosen[-1]], axis=1))
        out[n] = points[chosen]
    return out


def _celled(centres: dict[int, np.ndarray]):
    """Over rows (vec_id, asks, x): with the cell of the nearest centre and the distance to it; -1 where no centre has the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for n, own in centres.items():
                at = np.flatnonzero(sizes == n)
                for s in range(0, len(at), 1024):
                    some = at[s : s + 1024]
                    x = batch.column(2).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), n)
                    with np.errstate(over="ignore"):
                        d = np.stack([np.linalg.norm(x - c, axis=1) for c in own], axis=1)
                    cell[some], away[some] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return run


def _tops(x: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The greatest score that each row of ``x`` may have in each cell; rather too great than too small."""
    with np.errstate(over="ignore", invalid="ignore"):
        top = x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * radii
        top = top + 1e-9 * np.abs(top) + 1e-6
        return np.maximum(np.where(np.isnan(top), np.inf, top), float(_LEAST))


def _router(centres: dict[int, np.ndarray], radii: dict[tuple[int, int], float]):
    """Over queries (vec_id, x, home, least): each with the cells it must meet.

    Where ``home`` is null, the cell of the greatest bound (-1, which holds all
    data of a length without centres, else); where it is known, all other cells
    whose bound reaches the score ``least``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            home, least = batch.column(2).to_pylist(), batch.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            goes: list[list[int]] = [[-1] if h is None else [] for h in home]
            for n, own in centres.items():
                there = np.array(sorted(c for m, c in radii if m == n and c >= 0), np.int64)
                at = np.flatnonzero(sizes == n) if len(there) else []
                for s in range(0, len(at), 1024):
                    some = at[s : s + 1024]
                    x = batch.column(1).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), n)
                    for i, row in zip(some.tolist(), _tops(x, own[there], np.array([radii[n, c] for c in there.tolist()]))):
                        goes[i] = [int(there[row.argmax()])] if home[i] is None else [c for c in there[row >= least[i]].tolist() if c != home[i]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(goes, pa.list_(pa.int64()))], ["vec_id", "x", "least", "cells"])

    return run


def _pass(data: DataFrame, sizes: dict, routed: DataFrame, k: int, data_block: int, query_block: int) -> DataFrame:
    """The best ``k`` of each query of ``routed`` (vec_id, x, least, cell) in the cell it goes to."""
    spark = data.sparkSession
    asked = {(r["n"], r["cell"]): r["count"] for r in routed.groupBy(F.size("x").alias("n"), "cell").count().collect()}  # a row for each cell
    plan = [(n, c, -(-sizes[n, c] // data_block), -(-q // query_block)) for (n, c), q in asked.items() if (n, c) in sizes]
    table = F.broadcast(spark.createDataFrame(plan, "n int, cell long, over_data int, over_queries int"))  # a row for each cell
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda df: df.withColumn("n", F.size("x")).join(table, ["n", "cell"])
    rows = sized(data.select("vec_id", "x", "cell")).withColumn("asks", F.lit(False)).withColumn("least", F.lit(None).cast("double")).withColumn("a", place("over_data")).withColumn("b", every("over_queries"))
    asks = sized(routed).withColumn("asks", F.lit(True)).withColumn("b", place("over_queries")).withColumn("a", every("over_data"))
    key = F.concat_ws("/", "n", "cell", "a", "b")
    both = rows.select(key.alias("key"), "vec_id", "asks", "x", "least").unionByName(asks.select(key.alias("key"), "vec_id", "asks", "x", "least"))
    parts = max(1, min(sum(a * b for _, _, a, b in plan), 100_000))
    return both.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_searcher(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows of ``vectors`` (vec_id, embedding) where ``is_query`` holds, the ``k`` other rows of highest score.

    The score is the integer inner product of floor(scale * x); one beyond 64
    bits counts as the outermost 64-bit integer. Ties go to the smaller vec_id;
    a query with fewer candidates returns all. Vectors that are null, empty or
    hold a null or non-finite component (also after scaling), and rows without
    vec_id, take no part. Rows meet rows of equal length only. Rows with the
    query's vec_id are the query itself, so repeated rows never find each
    other; other rows find each of them. Other columns are ignored.

    Data of more than one block are cut into cells around a bounded sample of
    centres. A query first searches the cell of its greatest bound; the kth
    score found there is what every other cell's bound, and within a cell every
    pair of nodes, must reach. A cell and the queries that go there are spread
    by hash over blocks of bounded size, each pair of blocks is one tree search.
    """
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x * scale) & (F.abs(x * scale) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"), values.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            floors = np.floor(x.flatten().to_numpy(zero_copy_only=False) * scale)
            ends = np.concatenate([[0], np.cumsum(np.diff(x.offsets.to_numpy()))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(floors))], ["vec_id", "asks", "x"])

    rows = written(rows.select("vec_id", F.coalesce("asks", F.lit(False)).alias("asks"), "x").mapInArrow(scaled, "vec_id long, asks boolean, x array<double>"), "vectors")
    count = rows.count()
    centres = _centres(rows, min(CELLS, -(-count // data_block))) if count > data_block else {}
    found = rows.mapInArrow(_celled(centres), "vec_id long, asks boolean, x array<double>, cell long, away double")
    data = written(found, "cells") if centres else found
    cells = data.groupBy(F.size("x").alias("n"), "cell").agg(F.count("*").alias("docs"), F.max("away").alias("radius")).collect()  # a row for each cell
    sizes, radii = {(r["n"], r["cell"]): r["docs"] for r in cells}, {(r["n"], r["cell"]): r["radius"] for r in cells}
    nothing = F.lit(None).cast("long").alias("home"), F.lit(None).cast("double").alias("least")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    routed = lambda q: q.mapInArrow(_router(centres, radii), "vec_id long, x array<double>, least double, cells array<long>").select("vec_id", "x", "least", F.explode("cells").alias("cell"))
    asks = routed(data.where("asks").select("vec_id", "x", *nothing))
    if not centres:
        return ranked(_pass(data, sizes, asks, k, data_block, query_block)).select("query_id", "rank", "vec_id", "score")
    asks = written(asks, "asks")
    out = written(ranked(_pass(data, sizes, asks, k, data_block, query_block)).select("query_id", "vec_id", "score"), "first")
    # below its kth score a query wants nothing
    least = out.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("found")).select(F.col("query_id").alias("vec_id"), F.when(F.col("found") >= k, F.col("worst").cast("double")).alias("least"))
    again = written(routed(asks.drop("least").join(least, "vec_id", "left").select("vec_id", "x", F.col("cell").alias("home"), "least")), "again")
    out = ranked(out.unionByName(_pass(data, sizes, again, k, data_block, query_block)))
    return out.select("query_id", "rank", "vec_id", "score")
