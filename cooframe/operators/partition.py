"""Partitions of nodes, their halos and orderings."""

from __future__ import annotations

import functools
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..matrix import Matrix, bind
from .graph import ranked


def partition_simple(nodes: DataFrame, n: int, parts: int) -> DataFrame:
    """``node, part_id``: consecutive slices of ceil(n / parts) nodes."""
    size = max(1, -(-n // parts))
    return nodes.select("node", F.least(F.floor(F.col("node") / size), F.lit(parts - 1)).cast("int").alias("part_id"))


def partition_slices(coords: DataFrame, parts: int, axis: str = "x") -> DataFrame:
    """Equal counts along one axis, ties by node; ranks come from counts of ranges, not from one sorted task."""
    return _by_rank(coords.withColumn("_v", F.col(axis).cast("double")), parts)


def _by_rank(df: DataFrame, parts: int) -> DataFrame:
    """Slices of ``df`` (node, _v) in the order of (_v, node), by ranges of both, so equal values may lie in several ranges."""
    df = cut(df.select("node", "_v"))
    size = max(1, -(-df.count() // parts))
    return ranked(df, ["_v", "node"], "_rank").select("node", F.least(F.floor(F.col("_rank") / size), F.lit(parts - 1)).cast("int").alias("part_id"))


def partition_rcb(coords: DataFrame, parts: int, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Recursive cuts at the lower median of the longest axis; the side up to the median gets parts // 2.

    All groups of a level are cut in one pass: extents, then medians, grouped
    by the path so far.
    """
    state = coords.select("node", *axes, F.lit(0).alias("_first"), F.lit(parts).alias("_parts"))
    while True:
        state = cut(state)
        if state.where("_parts > 1").isEmpty():
            return state.select("node", F.col("_first").cast("int").alias("part_id"))
        live = state.where("_parts > 1")
        spans = live.groupBy("_first").agg(*[(F.max(a) - F.min(a)).alias(f"_s_{a}") for a in axes])
        longest = F.greatest(*[F.col(f"_s_{a}") for a in axes])
        which = F.coalesce(*[F.when(F.col(f"_s_{a}") == longest, F.lit(a)) for a in axes])
        axis = spans.select("_first", which.alias("_axis"))
        value = F.coalesce(*[F.when(F.col("_axis") == a, F.col(a)) for a in axes])
        valued = live.join(axis, "_first").withColumn("_v", value)
        medians = valued.groupBy("_first").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _v)").alias("_m"))
        cutted = valued.join(medians, "_first")
        left, half = F.col("_v") <= F.col("_m"), F.floor(F.col("_parts") / 2).cast("int")
        moved = cutted.select("node", *axes, F.when(left, F.col("_first")).otherwise(F.col("_first") + half).cast("int").alias("_first"), F.when(left, half).otherwise(F.col("_parts") - half).cast("int").alias("_parts"))
        state = state.where("_parts <= 1").unionByName(moved)


@functools.cache
def _hilbert_tables(d: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """For every turn of a cell and every corner, at turn * 2^d + corner: the turn of the cell in that corner, and the corner's place along the curve.

    A turn is the order of the axes, those that are mirrored, and whether the
    places so far mirror all of them.
    """
    first = (tuple(range(d)), (0,) * d, 0)
    turns, after, places = {first: 0}, [], []
    todo = [first]
    for axes, mirrored, odd in todo:
        for corner in range(1 << d):
            own = [corner >> (d - 1 - k) & 1 for k in range(d)]
            bits = [own[a] ^ m for a, m in zip(axes, mirrored)]
            order, flips = list(axes), list(mirrored)
            for k in range(d):
                if bits[k]:
                    flips[0] ^= 1
                else:
                    order[0], order[k], flips[0], flips[k] = order[k], order[0], flips[k], flips[0]
            gray, place = 0, 0
            for x in bits:
                gray ^= x
                place = place * 2 + (gray ^ odd)
            turn = (tuple(order), tuple(flips), odd ^ gray)
            if turn not in turns:
                turns[turn] = len(turns)
                todo.append(turn)
            after.append(turns[turn])
            places.append(place)
    return tuple(after), tuple(places)


def hilbert_index(coords: list[Column], order: int = 16) -> Column:
    """Place along the Hilbert curve of integer coordinates below 2^order, in two or three dimensions.

    One fold from the highest bit down, whose state holds the coordinates, the
    place so far and the turn of the cell: a row costs ``order`` steps, and
    neither the plan nor a step grows with ``order``.
    """
    d = len(coords)
    if d not in (2, 3):
        raise ValueError("two or three axes")
    names = [f"x{k}" for k in range(d)]
    after, places = (F.array(*[F.lit(x) for x in t]) for t in _hilbert_tables(d))

    def step(s: Column, k: Column) -> Column:
        at = s["turn"]
        for n in names:
            at = at * 2 + F.call_function("shiftright", s[n], k).bitwiseAND(1).cast("int")
        return F.struct(*[s[n].alias(n) for n in names], (s["at"] * (1 << d) + F.get(places, at)).alias("at"), F.get(after, at).alias("turn"))

    start = F.struct(*[x.cast("long").alias(n) for n, x in zip(names, coords)], F.lit(0).cast("long").alias("at"), F.lit(0).alias("turn"))
    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["at"])


def scaled(coords: DataFrame, axes: tuple[str, ...], order: int = 16) -> list[Column]:
    """Coordinates as integers from 0 to 2^order - 1, over each axis's own extent."""
    r = coords.agg(*[f(F.col(a).cast("double")).alias(f"{k}{a}") for a in axes for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for a in axes:
        lo, hi = r[f"lo{a}"] or 0.0, r[f"hi{a}"] or 0.0
        out.append(F.floor((F.col(a).cast("double") - lo) / ((hi - lo) or 1.0) * ((1 << order) - 1)).cast("long"))
    return out


def partition_hilbert(coords: DataFrame, parts: int, axes: tuple[str, ...] = ("x", "y"), order: int = 16) -> DataFrame:
    h = coords.select("node", hilbert_index(scaled(coords, axes, order), order).cast("double").alias("_v"))
    return _by_rank(h, parts)


def resolve_partition(a: Matrix, parts: int, method: str = "auto", coords: DataFrame | None = None, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``node, part_id`` by name: auto, simple, rcb, hilbert, slicing, metis."""
    nodes = a.spark.range(a.m).select(F.col("id").alias("node"))
    if method == "auto":
        method = "rcb" if coords is not None else "simple"
    if method == "metis":
        warnings.warn("there is no METIS here; consecutive slices stand in", stacklevel=2)
        method = "simple"
    if method == "simple":
        return partition_simple(nodes, a.m, parts)
    if method not in ("rcb", "hilbert", "slicing"):
        raise ValueError(f"no partition method {method!r}")
    if coords is None:
        raise ValueError(f"{method} needs coordinates")
    if method == "rcb":
        return partition_rcb(coords, parts, axes)
    return partition_hilbert(coords, parts, axes) if method == "hilbert" else partition_slices(coords, parts, axes[0])


def halo_nodes(a: Matrix, parts: DataFrame) -> DataFrame:
    """``part_id, node, owner``: nodes of other parts that an entry ties, either way, to a part's own."""
    p = parts.select(F.col("node").alias("row"), F.col("part_id").alias("_p"))
    q = parts.select(F.col("node").alias("col"), F.col("part_id").alias("_q"))
    crossing = a.df.select("row", "col").distinct().join(p, "row").join(q, "col").where("_p <> _q")
    return crossing.select(F.col("_p").alias("part_id"), F.col("col").alias("node"), F.col("_q").alias("owner")).union(crossing.select("_q", "row", "_p")).distinct()


def local_numbers(a: Matrix, parts: DataFrame) -> DataFrame:
    """``part_id, node, owned, local``: each part's own nodes in order, then its halo."""
    own = parts.select("part_id", "node", F.lit(True).alias("owned"))
    all_ = own.union(halo_nodes(a, parts).select("part_id", "node", F.lit(False)))
    return all_.withColumn("local", (F.row_number().over(Window.partitionBy("part_id").orderBy(F.col("owned").desc(), "node")) - 1).cast("long"))


def partitioned(a: Matrix, parts: DataFrame) -> Matrix:
    """Entries with the part of their row, exchanged by it."""
    p = parts.select(F.col("node").alias("row"), "part_id")
    return a.derived(a.df.join(p, "row").repartition("part_id"))


def exchange_sizes(a: Matrix, parts: DataFrame) -> DataFrame:
    """``part_id, owner, nodes``: how many values each part takes from each other one."""
    return halo_nodes(a, parts).groupBy("part_id", "owner").agg(F.count("*").alias("nodes"))


def rcm_order(a: Matrix) -> DataFrame:
    """``i, place``: reverse Cuthill-McKee, breadth first by ascending degree; in one task for each matrix."""
    from ..kernels.order import reverse_cuthill_mckee
    from .direct import gathered

    def run(e):
        p = reverse_cuthill_mckee(e.row, e.col, e.m)
        return {"i": p, "place": range(len(p))}

    return gathered(a, run, "i long, place long")


bind(resolve_partition, halo_nodes, local_numbers, partitioned, exchange_sizes, rcm_order)
