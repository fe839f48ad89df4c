"""Model problems as matrices made where they are used: ranges and projections, nothing on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complexes as C
from ..matrix import Matrix
from ..operators import products


def eye(spark: SparkSession, n: int) -> Matrix:
    return Matrix(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val")), n, n, coalesced=True)


def diag(vector: DataFrame, n: int) -> Matrix:
    if set(vector.columns) != {"i", "v"}:
        raise ValueError("a diagonal comes from one vector (i, v)")
    return Matrix(vector.select(F.col("i").alias("row"), F.col("i").alias("col"), F.col("v").alias("val")), n, n, coalesced=True)


def stencil(spark: SparkSession, dims: Sequence[int], centre: float | Column, edges: Sequence[tuple[Sequence[int], float]], is_complex: bool = False) -> Matrix:
    """Structured grid: a diagonal and an entry for each neighbour in the grid; places count row by row.

    Edges to one neighbour stay repeated entries.
    """
    n = 1
    for d in dims:
        n *= d
    i = F.col("id")
    place, rest = [], i
    for d in reversed(dims):
        place.insert(0, F.pmod(rest, F.lit(d)))
        rest = F.floor(rest / d)
    strides = [1] * len(dims)
    for k in range(len(dims) - 2, -1, -1):
        strides[k] = strides[k + 1] * dims[k + 1]
    value = (lambda v: C.literal(complex(v))) if is_complex else (lambda v: F.lit(float(v)))
    cells = [F.struct(i.alias("col"), F.lit(True).alias("inside"), value(centre).alias("val"))]
    for step, v in edges:
        inside = F.lit(True)
        for p, s, d in zip(place, step, dims):
            if s:
                inside = inside & (p + s >= 0) & (p + s < d)
        cells.append(F.struct((i + sum(s * t for s, t in zip(step, strides))).alias("col"), inside.alias("inside"), value(v).alias("val")))
    out = spark.range(n).select(i.alias("row"), F.explode(F.array(*cells)).alias("c")).where("c.inside").select("row", "c.col", "c.val")
    return Matrix(out, n, n, coalesced=len({tuple(s) for s, _ in edges}) == len(edges))


def _axes(d: int, value: float) -> list[tuple[tuple[int, ...], float]]:
    return [(tuple(s if k == axis else 0 for k in range(d)), value) for axis in range(d) for s in (-1, 1)]


def tridiagonal(spark: SparkSession, n: int, diag: float = 2.0, off_diag: float = -1.0) -> Matrix:
    return stencil(spark, [n], diag, _axes(1, off_diag))


def laplacian_1d(spark: SparkSession, n: int = 200) -> Matrix:
    return tridiagonal(spark, n)


def laplacian_2d(spark: SparkSession, m: int = 30) -> Matrix:
    return stencil(spark, [m, m], 4.0, _axes(2, -1.0))


def laplacian_3d(spark: SparkSession, m: int = 10) -> Matrix:
    return stencil(spark, [m, m, m], 6.0, _axes(3, -1.0))


def _sines(spark: SparkSession, m: int, d: int) -> DataFrame:
    """Product of sin(pi x) over the axes, on the inner nodes of the unit square or cube."""
    i, out = F.col("id"), F.lit(1.0)
    for k in range(d):
        out = out * F.sin(F.pi() * (F.pmod(F.floor(i / m**k), F.lit(m)) + 1) / (m + 1))
    return spark.range(m**d).select(i.alias("i"), out.alias("v"))


def poisson(spark: SparkSession, m: int, d: int) -> tuple[Matrix, DataFrame, DataFrame]:
    """(matrix, right side, exact solution) of the manufactured problem with the solution sin pi x sin pi y [sin pi z]."""
    h2 = float((m + 1) ** 2)
    a = stencil(spark, [m] * d, 2.0 * d * h2, _axes(d, -h2))
    exact = _sines(spark, m, d)
    return a, exact.select("i", (F.lit(float(d)) * F.pi() * F.pi() * F.col("v")).alias("v")), exact


def poisson_2d(spark: SparkSession, m: int = 31):
    return poisson(spark, m, 2)


def poisson_3d(spark: SparkSession, m: int = 10):
    return poisson(spark, m, 3)


def bratu_1d(spark: SparkSession, n: int = 100, lam: float = 1.0) -> tuple[Matrix, DataFrame]:
    """Linear part of -u'' = lam e^u and the closed-form solution."""
    import math

    theta = 1.0
    for _ in range(200):  # theta = sqrt(2 lam) cosh(theta / 4)
        theta = math.sqrt(2 * lam) * math.cosh(theta / 4)
    h2 = float((n + 1) ** 2)
    a = stencil(spark, [n], 2.0 * h2, _axes(1, -h2))
    x = (F.col("id") + 1) / (n + 1.0)
    u = -2.0 * F.ln(F.cosh((x - 0.5) * theta / 2.0) / math.cosh(theta / 4))
    return a, spark.range(n).select(F.col("id").alias("i"), u.alias("v"))


def helmholtz_1d(spark: SparkSession, n: int = 300, k: float = 8.0, alpha: float = 2.0) -> Matrix:
    h2 = float((n + 1) ** 2)
    return stencil(spark, [n], complex(2 * h2 - k * k, alpha * k), _axes(1, -h2), is_complex=True)


def anisotropic_2d(spark: SparkSession, m: int = 30, eps: float = 0.01) -> Matrix:
    """-eps u_xx - u_yy; x is the slow axis."""
    return stencil(spark, [m, m], 2 * eps + 2, [((-1, 0), -eps), ((1, 0), -eps), ((0, -1), -1.0), ((0, 1), -1.0)])


def advection_diffusion_2d(spark: SparkSession, m: int = 30, peclet: float = 20.0) -> Matrix:
    """Diffusion and upwind convection along both axes; the upwind neighbour has two entries."""
    p = peclet / (m + 1)
    return stencil(spark, [m, m], 4.0 + 2 * p, [*_axes(2, -1.0), ((-1, 0), -p), ((0, -1), -p)])


def kron_poisson_2d(spark: SparkSession, n: int = 64) -> Matrix:
    t, one = tridiagonal(spark, n), eye(spark, n)
    return products.plus(products.kron(one, t), products.kron(t, one))


def kron_poisson_3d(spark: SparkSession, n: int = 16) -> Matrix:
    t, one = tridiagonal(spark, n), eye(spark, n)
    flat = kron_poisson_2d(spark, n)
    return products.plus(products.kron(one, flat), products.kron(t, products.kron(one, one)))


def kron_anisotropic_2d(spark: SparkSession, n: int = 64, eps: float = 0.01) -> Matrix:
    t, one = tridiagonal(spark, n), eye(spark, n)
    return products.plus(products.kron(one, t * eps), products.kron(t, one))


def kron_convection_2d(spark: SparkSession, n: int = 64, peclet: float = 10.0) -> Matrix:
    back = stencil(spark, [n], 1.0, [((-1,), -1.0)]) * (peclet / (n + 1))
    one = eye(spark, n)
    return products.plus(kron_poisson_2d(spark, n), products.plus(products.kron(one, back), products.kron(back, one)))


def helmholtz_2d(spark: SparkSession, n: int = 64, k: float = 5.0, sigma: float = 0.5) -> Matrix:
    return stencil(spark, [n, n], complex(4 - k * k / (n + 1) ** 2, sigma), _axes(2, -1.0), is_complex=True)


def regularised_laplacian(adjacency: Matrix, eps: float = 1e-3) -> Matrix:
    """D - (A + A^T) / 2 without A's diagonal, + eps I: strictly dominant."""
    off = adjacency.df.where("row <> col").select("row", "col", (F.col("val") / 2).alias("val"))
    both = off.union(off.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    sym = both.groupBy("row", "col").agg(F.sum("val").alias("val"))
    degree = sym.groupBy(F.col("row").alias("i")).agg(F.sum("val").alias("d"))
    nodes = adjacency.spark.range(adjacency.m).select(F.col("id").alias("i"))
    on = nodes.join(degree, "i", "left").select(F.col("i").alias("row"), F.col("i").alias("col"), (F.coalesce("d", F.lit(0.0)) + eps).alias("val"))
    return Matrix(sym.select("row", "col", (-F.col("val")).alias("val")).union(on), adjacency.m, adjacency.m, coalesced=True)


def laplacian_1d_eigenvalues(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("k"), (2 - 2 * F.cos((F.col("id") + 1) * F.pi() / (n + 1))).alias("lambda"))


def laplacian_2d_eigenvalues(spark: SparkSession, m: int) -> DataFrame:
    one = lambda k: 2 - 2 * F.cos((k + 1) * F.pi() / (m + 1))
    i = F.col("id")
    return spark.range(m * m).select(i.alias("k"), (one(F.floor(i / m)) + one(F.pmod(i, F.lit(m)))).alias("lambda"))


PROBLEMS: dict[str, tuple[Callable, list[dict]]] = {
    "laplacian_1d": (laplacian_1d, [{"n": k} for k in (100, 1000, 10_000)]), "laplacian_2d": (laplacian_2d, [{"m": k} for k in (16, 64, 256)]), "laplacian_3d": (laplacian_3d, [{"m": k} for k in (8, 16, 32)]),
    "poisson_2d": (poisson_2d, [{"m": k} for k in (15, 31, 63)]), "poisson_3d": (poisson_3d, [{"m": k} for k in (7, 15)]), "bratu_1d": (bratu_1d, [{"n": k} for k in (50, 100)]), "helmholtz_1d": (helmholtz_1d, [{"n": k} for k in (100, 300)]),
    "anisotropic_2d": (anisotropic_2d, [{"m": k} for k in (16, 30)]), "advection_diffusion_2d": (advection_diffusion_2d, [{"m": k} for k in (16, 30)]), "kron_poisson_2d": (kron_poisson_2d, [{"n": k} for k in (16, 64)]), "kron_poisson_3d": (kron_poisson_3d, [{"n": 16}]),
    "kron_anisotropic_2d": (kron_anisotropic_2d, [{"n": 64}]), "kron_convection_2d": (kron_convection_2d, [{"n": 64}]), "helmholtz_2d": (helmholtz_2d, [{"n": 64}]),
}


def get(spark: SparkSession, name: str, **kwargs):
    return PROBLEMS[name][0](spark, **kwargs)


def default_sizes(name: str) -> list[dict]:
    return PROBLEMS[name][1]
