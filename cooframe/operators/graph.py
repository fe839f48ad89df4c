"""Connected components of the pattern, and splits along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, drop
from ..kernels import components as kernel
from ..matrix import Matrix, bind
from ..sizes import parts
from .products import BROADCAST_ROWS

#: A component's nodes are numbered in stretches of so many places.
STRETCH = 1 << 16


def _stars(batches):
    import numpy as np
    import pyarrow as pa

    pairs = ((np.asarray(b.column("row")), np.asarray(b.column("col"))) for b in batches if b.num_rows)
    for node, root in kernel.joined(pairs):
        yield from pa.table({"node": node, "root": root}).to_batches(1 << 17)


def component_roots(edges: DataFrame, nodes: DataFrame, rounds: int = 80) -> DataFrame:
    """``node, root``: the least node that each node reaches, over undirected ``edges`` (row, col); loops count for nothing.

    Each task joins the edges that it reads and gives its nodes the least one
    of their component there. The roots that a node has from several tasks are
    tied in turn: a smaller graph, of roots alone, which one task settles where
    it can, else the same again or, where that no longer helps, rounds of
    hooking and jumping.
    """
    own = edges.where("row <> col").select("row", "col")
    n = parts(own)
    seen = own.mapInArrow(_stars, "node long, root long")
    if n is not None:
        seen, nodes = seen.repartition(n, "node"), nodes.repartition(n, "i")
    by = Window.partitionBy("node")
    ranks = seen.select("node", "root", F.row_number().over(by.orderBy("root")).alias("_at"), F.min("root").over(by).alias("_least"))
    met = cut(ranks.where("_at = 1 or root <> _least"))
    ties = cut(met.where("_at > 1").select(F.col("root").alias("row"), F.col("_least").alias("col")).distinct())
    left = ties.count()
    up = met.where("_at = 1").select("node", F.col("_least").alias("_up"))
    if not left:
        found = nodes.select(F.col("i").alias("node")).join(up, "node", "left").select("node", F.coalesce("_up", "node").alias("root"))
        return _kept(found, met, ties)
    if left <= kernel.EDGES // 4:
        above = ties.repartition(1).mapInArrow(_stars, "node long, root long")
    else:
        ends = ties.select(F.col("row").alias("i")).union(ties.select("col")).distinct()
        above = component_roots(ties, ends, rounds) if left <= met.count() // 2 else _by_rounds(ties, ends, rounds)
    above = cut(above.where("node <> root").select(F.col("node").alias("_up"), F.col("root").alias("_top")))
    if above.count() <= BROADCAST_ROWS:
        above = F.broadcast(above)  # most nodes may have one of few roots
    found = nodes.select(F.col("i").alias("node")).join(up, "node", "left").select("node", F.coalesce("_up", "node").alias("_up"))
    return _kept(found.join(above, "_up", "left").select("node", F.coalesce("_top", "_up").alias("root")), met, ties)


def _kept(found: DataFrame, *frames: DataFrame) -> DataFrame:
    out = cut(found)
    for f in frames:
        drop(f)
    return out


def _by_rounds(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``component_roots`` by rounds: each hooks every tree's root to the least root next to the tree and then jumps pointers once.

    A round is one written table, so plans stay flat.
    """
    both = cut(edges.where("row <> col").select("row", "col").union(edges.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"))).distinct())
    parent = cut(nodes.select(F.col("i").alias("node"), F.col("i").alias("root")))
    before = None
    for _ in range(rounds):
        near = both.join(parent.select(F.col("node").alias("col"), F.col("root").alias("_other")), "col").groupBy(F.col("row").alias("node")).agg(F.min("_other").alias("_near"))
        hook = parent.join(near, "node").groupBy("root").agg(F.min("_near").alias("_to"))
        hooked = parent.join(hook, "root", "left").select("node", F.least("root", F.coalesce("_to", "root")).alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        old, parent = parent, cut(hooked.join(jump, "root").select("node", F.col("_up").alias("root")))
        drop(old)
        state = parent.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if state == before:
            drop(both)
            return parent
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def ranked(df: DataFrame, by: str | list[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of the distinct values ``by``, part by part of a range exchange.

    Only the number of rows of each part goes to the driver.
    """
    by = [by] if isinstance(by, str) else by
    laid = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    base, at = [], 0
    for p, n in sorted((r["_part"], r["count"]) for r in laid.groupBy("_part").count().collect()):
        base.append((p, at))
        at += n
    first = F.broadcast(laid.sparkSession.createDataFrame(base, "_part int, _base long"))  # a row for each part
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return laid.withColumn("_place", place).join(first, "_part").withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_part", "_place", "_base")


def connected_components(a: Matrix) -> DataFrame:
    """``i, label``: components numbered in the order of their least nodes; a batch shares one pattern, so one labelling."""
    if not a.is_square:
        raise ValueError("components are of a square pattern")
    edges = a.df.where("batch_id = 0") if a.keys == ("batch_id",) else a.df
    if a.sizes is not None:
        raise ValueError("take the components of one matrix of a list at a time")
    nodes = a.spark.range(a.m).select(F.col("id").alias("i"))
    roots = component_roots(edges, nodes)
    ranks = ranked(roots.where("node = root").select("root"), "root", "label")
    if ranks.count() <= BROADCAST_ROWS:
        ranks = F.broadcast(ranks)  # most nodes may have one of few roots
    return roots.join(ranks, "root").select(F.col("node").alias("i"), "label")


def n_components(a: Matrix) -> int:
    return connected_components(a).select("label").distinct().count()


def has_isolated_components(a: Matrix) -> bool:
    return n_components(a) > 1


def to_connected_components(a: Matrix) -> Matrix:
    """A list with one matrix for each component, nodes renumbered in order."""
    if a.keys:
        raise NotImplementedError("components of a batch are not split")
    labels = connected_components(a).withColumn("_s", F.floor(F.col("i") / STRETCH))
    counts = labels.groupBy("label", "_s").agg(F.count("*").alias("_n"))
    before = counts.select("label", "_s", (F.sum("_n").over(Window.partitionBy("label").orderBy("_s")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("label", "_s").orderBy("i")) - 1
    local = labels.withColumn("_place", place).join(before, ["label", "_s"]).select("i", "label", (F.col("_before") + F.col("_place")).cast("long").alias("local"))
    sizes = labels.groupBy(F.col("label").alias("matrix_id")).agg(F.count("*").alias("m")).withColumn("n", F.col("m"))
    rows = local.select(F.col("i").alias("row"), F.col("label").alias("matrix_id"), F.col("local").alias("_r"))
    cols = local.select(F.col("i").alias("col"), F.col("local").alias("_c"))
    out = a.df.join(rows, "row").join(cols, "col").select("matrix_id", F.col("_r").alias("row"), F.col("_c").alias("col"), "val")
    return Matrix(out, keys=("matrix_id",), sizes=sizes, coalesced=a.coalesced)


bind(connected_components, n_components, has_isolated_components, to_connected_components)
