"""Gradients of scalar functions of results with respect to stored values: joins at the pattern of the matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix, bind
from ..sizes import spread
from . import blocks
from .direct import gathered, solve
from .products import BROADCAST_ROWS, _sized, matmul_at


def at_pattern(a: Matrix, left: DataFrame, right: DataFrame, sign: float = 1.0) -> DataFrame:
    """``[keys,] row, col, v`` = sign * sum over k of left[row, k] * right[col, k], at A's places only.

    Where there is one vector a side each place has one term, so places are not
    grouped again; values that a vector repeats for a place are added up first.
    """
    many = ["k"] if "k" in left.columns else []
    if not many and not a.keys:
        one = lambda v, name, to, n: _sized(v.groupBy(F.col("i").alias(name)).agg(F.sum("v").alias(to)), n)
        both = a.coalesce().df.select("row", "col").join(one(left, "row", "_x", a.m), "row")
        both = (both if a.n <= BROADCAST_ROWS else spread(both, "col")).join(one(right, "col", "_y", a.n), "col")
        return both.select("row", "col", (sign * (F.col("_x") * F.col("_y"))).alias("v"))
    x = left.select(*a.keys, F.col("i").alias("row"), *many, F.col("v").alias("_x"))
    y = right.select(*a.keys, F.col("i").alias("col"), *many, F.col("v").alias("_y"))
    both = a.coalesce().df.select(*a.keys, "row", "col").join(x, [*a.keys, "row"]).join(y, [*a.keys, "col", *many])
    return both.groupBy(*a.keys, "row", "col").agg((sign * F.sum(F.col("_x") * F.col("_y"))).alias("v"))


def matvec_vjp(a: Matrix, x: DataFrame, g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For y = A x: gradients at A's places (g x^T) and of x (A^T g)."""
    return at_pattern(a, g, x), a.T.matvec(g)


def solve_vjp(a: Matrix, b: DataFrame, g: DataFrame, method: str = "auto") -> tuple[DataFrame, DataFrame]:
    """For x = A^-1 b: w = A^-T g is the gradient of b, -w x^T at A's places that of A."""
    w = solve(a.T, g, method)
    return at_pattern(a, w, solve(a, b, method), -1.0), w


def matmul_vjp(a: Matrix, b: Matrix, g: Matrix, needs: tuple[bool, bool] = (True, True)) -> tuple[DataFrame | None, DataFrame | None]:
    """For C = A B: G B^T at A's places and A^T G at B's; None for a side that is not needed."""
    if blocks.fit(a, b):
        a, b = blocks.settled(a), blocks.settled(b)
    at = lambda m: m.coalesce().df.select(*m.keys, "row", "col")
    left = matmul_at(g, b.T, at(a), by="right") if needs[0] else None
    return left, matmul_at(a.T, g, at(b), by="left") if needs[1] else None


def sum_vjp(a: Matrix, axis: int, g: DataFrame) -> DataFrame:
    """For sums along an axis: each place has its bucket's gradient."""
    by = "row" if axis == 1 else "col"
    return a.df.select(*a.keys, "row", "col").join(g.select(*a.keys, F.col("i").alias(by), "v"), [*a.keys, by])


def _at(e, m: np.ndarray) -> dict:
    return {"row": e.row, "col": e.col, "v": m}


def det_vjp(a: Matrix, g: float = 1.0) -> DataFrame:
    """g det(A) A^-T at A's places, by cofactors where A is singular of rank n - 1."""

    def run(e):
        d = e.dense()
        u, s, vh = np.linalg.svd(d)
        n = len(s)
        # adj(A) = det(U V) V diag(products of the other singular values) U^T
        others = np.array([np.prod(np.delete(s, k)) for k in range(n)])
        adjugate = np.linalg.det(u) * np.linalg.det(vh) * (vh.T * others) @ u.T
        return _at(e, g * adjugate[e.col, e.row])

    return gathered(a, run, "row long, col long, v double")


def logdet_vjp(a: Matrix, g: float = 1.0) -> DataFrame:
    """g A^-T at A's places."""

    def run(e):
        return _at(e, g * np.linalg.inv(e.dense())[e.col, e.row])

    return gathered(a, run, "row long, col long, v double")


def hutchinson_logdet_vjp(a: Matrix, probes: int = 20, seed: int = 0, rtol: float = 1e-10) -> DataFrame:
    """Mean over sign vectors z of z[row] (A^-1 z)[col], for positive definite matrices."""
    from ..kernels import krylov as K

    def run(e):
        rng = np.random.default_rng(seed + 991)
        out = np.zeros(len(e.val))
        for _ in range(probes):
            z = rng.integers(0, 2, e.n) * 2.0 - 1.0
            out += z[e.row] * K.cg(e.matvec, z, rtol=rtol)[0][e.col]
        return _at(e, out / probes)

    return gathered(a, run, "row long, col long, v double")


def eigsh_vjp(a: Matrix, weights: list[float], which: str = "LM") -> DataFrame:
    """For the sum of weights[k] * lambda[k]: sum of weights[k] v_k[row] v_k[col]."""
    from .spectral import _pick

    def run(e):
        values, vectors = np.linalg.eigh(e.dense())
        at = _pick(values, len(weights), which)
        return _at(e, sum(w * vectors[e.row, k] * vectors[e.col, k] for w, k in zip(weights, at)))

    return gathered(a, run, "row long, col long, v double")


def svd_vjp(a: Matrix, weights: list[float]) -> DataFrame:
    """For the sum of weights[k] * s[k], largest first: sum of weights[k] u_k[row] v_k[col]."""

    def run(e):
        u, s, vh = np.linalg.svd(e.dense(), full_matrices=False)
        return _at(e, sum(w * u[e.row, k] * vh[k, e.col] for k, w in enumerate(weights[: len(s)])))

    return gathered(a, run, "row long, col long, v double")


def nonlinear_vjp(a: Matrix, diagonal_shift: DataFrame, g: DataFrame, method: str = "auto") -> DataFrame:
    """For a root of A u + h(u) = rhs: w of (A + diag(h'(u)))^T w = g, the gradient of rhs."""
    shift = Matrix(diagonal_shift.select(F.col("i").alias("row"), F.col("i").alias("col"), F.col("v").alias("val")), a.m, a.n)
    return solve(a.plus(shift).T, g, method)


bind(matvec_vjp, solve_vjp, matmul_vjp, sum_vjp, det_vjp, logdet_vjp, hutchinson_logdet_vjp, eigsh_vjp, svd_vjp, nonlinear_vjp)
