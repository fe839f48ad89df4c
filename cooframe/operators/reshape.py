"""Blocks, lists and block-diagonal matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import Matrix, bind


def flatten_blocks(a: Matrix) -> Matrix:
    """Blocks to single entries, row by row within each block."""
    if len(a.block) != 2:
        raise ValueError("blocks of two axes are flattened")
    p, q = a.block
    rows = a.df.select(*a.keys, "row", "col", F.posexplode("val").alias("_i", "_r"))
    cells = rows.select(*a.keys, "row", "col", "_i", F.posexplode("_r").alias("_j", "val"))
    return a.derived(cells.select(*a.keys, (F.col("row") * p + F.col("_i")).alias("row"), (F.col("col") * q + F.col("_j")).alias("col"), "val"), m=a.m * p, n=a.n * q, block=(), coalesced=a.coalesced)


def unflatten_blocks(a: Matrix, block: tuple[int, int]) -> Matrix:
    """Single entries to whole blocks; a block with a missing entry fails."""
    p, q = block
    if a.m % p or a.n % q:
        raise ValueError(f"{a.m} x {a.n} does not divide into blocks of {p} x {q}")
    cell = F.struct((F.col("row") % p).alias("i"), (F.col("col") % q).alias("j"), F.col("val").alias("v"))
    found = a.coalesce().df.groupBy(*a.keys, F.floor(F.col("row") / p).alias("row"), F.floor(F.col("col") / q).alias("col")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    flat = F.when(F.size("c") != p * q, F.raise_error(F.concat(F.lit("the block at "), F.col("row"), F.lit(", "), F.col("col"), F.lit(" is not whole")))).otherwise(F.col("c.v"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.slice(flat, i * q + 1, F.lit(q)))
    return a.derived(found.select(*a.keys, "row", "col", rows.alias("val")), m=a.m // p, n=a.n // q, block=block, coalesced=True)


def _offsets(sizes: DataFrame) -> DataFrame:
    """Where each matrix of a list begins; a row for each matrix."""
    before = Window.orderBy("matrix_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("matrix_id", "m", "n", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c0"))


def to_block_diagonal(a: Matrix) -> Matrix:
    """The matrices of a list along one diagonal, in order."""
    m, n = a.total_shape()
    out = a.df.join(_offsets(a.sizes), "matrix_id").select((F.col("row") + F.col("r0")).alias("row"), (F.col("col") + F.col("c0")).alias("col"), "val")
    return Matrix(out, m, n, coalesced=a.coalesced)


def from_block_diagonal(a: Matrix, sizes: Sequence[tuple[int, int]]) -> Matrix:
    """Split along the diagonal by sizes that add up to the shape; entries outside the blocks go.

    Bounds of rows are looked up by a join on coarse cells, so that no entry
    meets every block.
    """
    if (sum(m for m, _ in sizes), sum(n for _, n in sizes)) != (a.m, a.n):
        raise ValueError("the sizes do not add up to the shape")
    spark = a.spark
    meta = spark.createDataFrame([(k, m, n) for k, (m, n) in enumerate(sizes)], "matrix_id long, m long, n long")
    cell = max(1, a.m // max(1, len(sizes)))
    bounds = _offsets(meta).where("m > 0").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("r0") / cell), F.floor((F.col("r0") + F.col("m") - 1) / cell))))
    own = a.df.withColumn("_cell", F.floor(F.col("row") / cell))
    found = own.join(bounds, "_cell").where((F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r0") + F.col("m")) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c0") + F.col("n")))
    out = found.select("matrix_id", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "val")
    return Matrix(out, keys=("matrix_id",), sizes=meta, coalesced=a.coalesced)


def extract(a: Matrix, nodes: DataFrame, part: int) -> Matrix:
    """One part's rows in local numbers: columns it owns first, then those of its halo. ``nodes``: part_id, node, local, owned."""
    own = nodes.where(F.col("part_id") == part)
    rows = own.where("owned").select(F.col("node").alias("row"), F.col("local").alias("_r"))
    cols = own.select(F.col("node").alias("col"), F.col("local").alias("_c"))
    m, n = own.where("owned").count(), own.count()
    return Matrix(a.df.join(rows, "row").join(cols, "col").select(F.col("_r").alias("row"), F.col("_c").alias("col"), "val"), m, n, coalesced=a.coalesced)


bind(flatten_blocks, unflatten_blocks, to_block_diagonal, extract)
Matrix.from_block_diagonal = from_block_diagonal
