"""Sums, means, products, extremes, norms and the diagonal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as C
from ..functions import ieee
from ..matrix import Matrix, bind

AXES = {0: "row", 1: "col"}


def filled(a: Matrix, axis: int, found: DataFrame, names: tuple[str, ...] = ("v",), zero=0.0) -> DataFrame:
    """``[keys,] i`` and values for every place along ``axis``; ``zero`` where ``found`` has none."""
    on = [*a.keys, "i"]
    all_ = a.index(axis)
    value = [F.coalesce(F.col(n), _zero(found, n, zero)).alias(n) for n in names]
    return all_.join(found, on, "left").select(*on, *value)


def _zero(found: DataFrame, name: str, zero) -> Column:
    kind = found.schema[name].dataType.simpleString()
    return C.of(0.0, 0.0) if kind.startswith("struct") else F.lit(zero).cast(kind)


def _along(axis: int) -> tuple[int, str]:
    """The axis that stays when ``axis`` is summed over, and its column."""
    if axis not in (0, 1):
        raise ValueError(f"axis {axis}: 0 sums over rows, 1 over columns")
    return 1 - axis, AXES[1 - axis]


def _grouped(a: Matrix, axis: int, *aggs: Column) -> DataFrame:
    _, by = _along(axis)
    return a.df.groupBy(*a.keys, F.col(by).alias("i")).agg(*aggs)


def _sum(a: Matrix) -> Column:
    return C.total(F.col("val")) if a.is_complex else F.sum("val")


def sum(a: Matrix, axis: int | None = None) -> DataFrame:  # noqa: A001
    """Of all stored values (axis None), or ``i, v`` for every column (0) or row (1), zeros included."""
    if axis is None:
        return a.df.groupBy(*a.keys).agg(_sum(a).alias("v"))
    return filled(a, _along(axis)[0], _grouped(a, axis, _sum(a).alias("v")))


def sum_batch(a: Matrix) -> Matrix:
    """Sum of a batch, or of a list of one shape, as a matrix."""
    m, n = (a.m, a.n) if a.sizes is None else tuple(a.sizes.agg(F.max("m"), F.max("n")).first())
    return Matrix(a.df.groupBy("row", "col").agg(_sum(a).alias("val")), m, n, coalesced=True)


def sum_blocks(a: Matrix) -> Matrix:
    """Sum within each block."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return a.derived(a.df.select(*a.keys, "row", "col", F.aggregate("val", F.lit(0.0), lambda s, v: s + total(v)).alias("val")), block=())


def sums_by_all_axes(a: Matrix) -> DataFrame:
    """Row sums, column sums and the total in one pass: ``axis, i, v`` over stored rows and columns."""
    out = a.df.groupingSets([[F.col("row")], [F.col("col")], []], "row", "col").agg(F.sum("val").alias("v"))
    axis = F.when(F.col("row").isNotNull(), "row").when(F.col("col").isNotNull(), "col").otherwise("all")
    return out.select(axis.alias("axis"), F.coalesce("row", "col", F.lit(-1).cast("long")).alias("i"), "v")


def mean(a: Matrix, axis: int | None = None, over: str = "bucket") -> DataFrame:
    """Mean of stored values; along an axis each bucket's own, or with ``over="all"`` its sum by all stored entries."""
    if axis is None:
        return a.df.groupBy(*a.keys).agg(F.avg("val").alias("v"))
    if over == "bucket":
        return filled(a, _along(axis)[0], _grouped(a, axis, F.avg("val").alias("v")))
    counts = a.df.groupBy(*a.keys).agg(F.count("*").alias("_n"))
    sums = sum(a, axis)
    joined = sums.join(counts, list(a.keys)) if a.keys else sums.crossJoin(F.broadcast(counts))  # one row
    return joined.select(*a.keys, "i", ieee.div(F.col("v"), F.col("_n")).alias("v"))


def _dense_extreme(a: Matrix, axis: int | None, whole: Column, meets_zero) -> DataFrame:
    if axis is None:
        return a.df.groupBy(*a.keys).agg(whole.alias("v"))
    a = a.coalesce()
    found = _grouped(a, axis, whole.alias("v"), F.count("*").alias("_n"))
    if a.sizes is not None:
        full = F.col("m" if axis == 0 else "n")
        found = found.join(a.sizes, "matrix_id")
    else:
        full = F.lit(a.m if axis == 0 else a.n)
    value = F.when(F.col("_n") < full, meets_zero(F.col("v"))).otherwise(F.col("v"))
    return filled(a, _along(axis)[0], found.select(*a.keys, "i", value.alias("v")))


def prod(a: Matrix, axis: int | None = None) -> DataFrame:
    """Product of stored values; along an axis absent places count as zero."""
    return _dense_extreme(a, axis, F.product("val"), lambda v: F.lit(0.0))


def max(a: Matrix, axis: int | None = None) -> DataFrame:  # noqa: A001
    """Largest stored value; along an axis absent places compete as zero. NaN wins."""
    return _dense_extreme(a, axis, ieee.greatest_of(F.col("val")), lambda v: F.greatest(v, F.lit(0.0)))


def min(a: Matrix, axis: int | None = None) -> DataFrame:  # noqa: A001
    """Smallest stored value; along an axis absent places compete as zero. NaN wins."""
    return _dense_extreme(a, axis, ieee.least_of(F.col("val")), lambda v: F.when(F.isnan(v), v).otherwise(F.least(v, F.lit(0.0))))


def norm(a: Matrix, ord: str | int | float = "fro") -> DataFrame:  # noqa: A002
    """``[keys,] v``: fro, 1, -1, inf, -inf, 2 or -2.

    Frobenius is over stored values as they are; the others add repeated
    entries up. 1 and inf are the greatest column and row sum of sizes, their
    negatives the least, absent rows and columns counting as 0.
    """
    if ord == "fro":
        v = C.magnitude(F.col("val")) if a.is_complex else F.col("val")
        return a.df.groupBy(*a.keys).agg(F.sqrt(F.sum(v * v)).alias("v"))
    if ord in (2, -2):
        from .spectral import singular_values

        s = singular_values(a)
        return s.groupBy(*a.keys).agg((F.max("s") if ord == 2 else F.min("s")).alias("v"))
    if ord in (1, -1, float("inf"), float("-inf")):
        sums = sum(a.coalesce().abs(), 0 if abs(ord) == 1 else 1)
        return sums.groupBy(*a.keys).agg((F.max("v") if ord > 0 else F.min("v")).alias("v"))
    raise ValueError(f"no norm {ord!r}")


def abs_axis_sum(a: Matrix, axis: int) -> DataFrame:
    return sum(a.abs(), axis)


def diagonal(a: Matrix) -> DataFrame:
    """``[keys,] i, v``: repeated entries added up, zero where absent."""
    found = a.df.where("row = col").groupBy(*a.keys, F.col("row").alias("i")).agg(_sum(a).alias("v"))
    axis = 0 if a.sizes is not None or a.m <= a.n else 1
    return filled(a, axis, found)


bind(sum, sum_batch, sum_blocks, sums_by_all_axes, mean, prod, max, min, norm, abs_axis_sum, diagonal)
