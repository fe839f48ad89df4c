"""F(u) = 0 where F(u) = A u + g(u) over the cluster, or any function of NumPy vectors in one place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..kernels import krylov as K
from ..kernels.sparse import Entries
from ..kernels.sparse import solve as kernel_solve
from ..matrix import Matrix, bind
from .krylov import Operator, to_driver, to_frame


@dataclass(frozen=True)
class Root:
    u: np.ndarray
    iterations: int
    residual: float
    converged: bool


def armijo(f: Callable, u, du, size: float, c: float = 1e-4, rho: float = 0.5, tries: int = 20):
    """The first of steps 1, rho, rho^2, ... that lowers |F| enough; the last one if none does."""
    step = 1.0
    for _ in range(tries):
        if np.linalg.norm(f(u + step * du)) <= (1 - c * step) * size:
            break
        step *= rho
    return u + step * du


def newton(f: Callable, u0, solve_step: Callable, tol: float = 1e-8, atol: float = 1e-12, max_iter: int = 50, line_search: bool = True) -> Root:
    """``solve_step(u, r)`` solves J(u) du = r."""
    u, r = np.array(u0, float), f(u0)
    size = first = float(np.linalg.norm(r))
    it = 0
    while size > max(atol, tol * first) and it < max_iter:
        du = solve_step(u, -r)
        u = armijo(f, u, du, size) if line_search else u + du
        r = f(u)
        size = float(np.linalg.norm(r))
        it += 1
    return Root(u, it, size, size <= max(atol, tol * first))


def picard(f: Callable, u0, tol: float = 1e-8, atol: float = 1e-12, max_iter: int = 1000) -> Root:
    """u <- u - F(u)."""
    u = np.array(u0, float)
    r = f(u)
    first = float(np.linalg.norm(r))
    it = 0
    while np.linalg.norm(r) > max(atol, tol * first) and it < max_iter:
        u = u - r
        r = f(u)
        it += 1
    size = float(np.linalg.norm(r))
    return Root(u, it, size, size <= max(atol, tol * first))


def anderson(f: Callable, u0, depth: int = 5, tol: float = 1e-8, atol: float = 1e-12, max_iter: int = 500) -> Root:
    """Fixed points of u - F(u), mixed over the last ``depth`` steps."""
    u = np.array(u0, float)
    r = -f(u)
    first = float(np.linalg.norm(r))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    it = 0
    while np.linalg.norm(r) > max(atol, tol * first) and it < max_iter:
        steps = [*steps[-depth:], (u, r)]
        if len(steps) > 1:
            dr = np.stack([r - x for _, x in steps[:-1]], axis=1)
            du = np.stack([u - x for x, _ in steps[:-1]], axis=1)
            g = np.linalg.solve(dr.T @ dr + 1e-10 * np.eye(dr.shape[1]), dr.T @ r)
            u = u + r - (du + dr) @ g
        else:
            u = u + r
        r = -f(u)
        it += 1
    size = float(np.linalg.norm(r))
    return Root(u, it, size, size <= max(atol, tol * first))


def finite_difference_jacobian(f: Callable, u: np.ndarray) -> np.ndarray:
    r = f(u)
    h = 1e-7 * np.maximum(1, np.abs(u))
    return np.stack([(f(u + h[k] * e) - r) / h[k] for k, e in enumerate(np.eye(len(u)))], axis=1)


def nonlinear_solve(f: Callable, u0, jacobian: Callable | None = None, method: str = "newton", **options) -> Root:
    """newton, picard or anderson; ``jacobian(u)`` gives (values, rows, columns, shape), else differences do."""
    if method == "picard":
        return picard(f, u0, **options)
    if method == "anderson":
        return anderson(f, u0, **options)
    if method != "newton":
        raise ValueError(f"no method {method!r}")

    def step(u, r):
        if jacobian is None:
            return np.linalg.solve(finite_difference_jacobian(f, u), r)
        val, row, col, shape = jacobian(u)
        return kernel_solve(Entries(row, col, val, *shape), r)[0]

    return newton(f, u0, step, **options)


def jacobian_free(f: Callable, u0, tol: float = 1e-8, max_iter: int = 50, inner: dict | None = None) -> Root:
    """Newton with J v by a difference along v, inside GMRES."""

    def step(u, r):
        base = f(u)

        def product(v):
            h = 1e-7 * max(1.0, float(np.linalg.norm(u))) / max(float(np.linalg.norm(v)), 1e-300)
            return (f(u + h * v) - base) / h

        return K.gmres(product, r, **({"rtol": 1e-8, "maxiter": 500} | (inner or {})))[0]

    return newton(f, u0, step, tol=tol, max_iter=max_iter)


def newton_distributed(a: Matrix, g: Callable, g_prime: Callable, u0: DataFrame | None = None, rhs: DataFrame | None = None, tol: float = 1e-10, atol: float = 1e-12, max_iter: int = 50, adjoint: DataFrame | None = None):
    """A u + g(u) = rhs with a pointwise g; J = A + diag(g'(u)), products over the cluster.

    With ``adjoint`` (i, v) also solves J(u)^T w = adjoint and returns (u, w, root).
    """
    op = Operator(a)
    side = to_driver(rhs, a.m) if rhs is not None else 0.0
    start = to_driver(u0, a.m) if u0 is not None else np.zeros(a.m)
    f = lambda u: op(u) + g(u) - side
    step = lambda u, r: K.gmres(lambda v: op(v) + g_prime(u) * v, r, rtol=1e-10, atol=1e-13, maxiter=1000)[0]
    root = newton(f, start, step, tol, atol, max_iter)
    frame = to_frame(a.spark, root.u)
    if adjoint is None:
        return frame, root
    w = K.gmres(lambda v: op.transposed(v) + g_prime(root.u) * v, to_driver(adjoint, a.m), rtol=1e-10, atol=1e-13, maxiter=1000)[0]
    return frame, to_frame(a.spark, w), root


bind(newton_distributed)
