"""Eigenvalues, singular values, condition numbers and determinants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as C
from ..functions import ieee
from ..kernels import krylov as K
from ..kernels.sparse import DENSE_DIRECT, Entries, direct
from ..matrix import Matrix, bind
from .direct import dense_apply, gathered
from .krylov import Operator

WHICH = ("LM", "SM", "LA", "SA", "LR", "SR")


def _pick(values: np.ndarray, k: int, which: str) -> np.ndarray:
    """Places of k eigenvalues: LM/SM by size, LA/SA (LR/SR) by (real) value; the extreme one first."""
    if which not in WHICH:
        raise ValueError(f"which {which!r}")
    rank = np.abs(values) if which in ("LM", "SM") else values.real
    order = np.argsort(-rank if which[0] == "L" else rank, kind="stable")
    return order[:k]


def _settled(v: np.ndarray) -> np.ndarray:
    """Each vector with its largest component positive, so that results agree between runs."""
    top = np.argmax(np.abs(v), axis=0)
    lead = v[top, np.arange(v.shape[1])]
    return v * np.conj(lead / np.abs(np.where(lead == 0, 1, lead)))


def eigsh(a: Matrix, k: int = 6, which: str = "LM", sigma: float | None = None) -> DataFrame:
    """``[keys,] k, lambda, vector array<double>`` of symmetric (Hermitian) matrices, in one task each.

    With ``sigma`` the eigenvalues sought are those of which 1 / (lambda -
    sigma) is extreme: LM gives the nearest to sigma. Matrices beyond dense
    size go by Lanczos steps, with ``sigma`` on a sparse factor of A - sigma.
    """
    is_complex = a.is_complex

    def run(e):
        if e.m <= DENSE_DIRECT:
            values, vectors = np.linalg.eigh(e.dense())
            at = _pick(values if sigma is None else _shifted(values, sigma), k, which)
            values, v = values[at], _settled(vectors[:, at])
        else:
            times = e.matvec
            if sigma is not None:
                i = np.arange(e.m)
                times = direct(Entries(np.concatenate([e.row, i]), np.concatenate([e.col, i]), np.concatenate([e.val, np.full(e.m, -sigma)]), e.m, e.n)).solve
            values, v = K.lanczos(times, e.m, k, lambda x: _pick(x, k, which), e.val.dtype)
            values, v = values if sigma is None else sigma + 1 / values, _settled(v)
        out = {"k": np.arange(len(values)), "lambda": values, "vector": [c.real.tolist() for c in v.T]}
        return out | ({"imaginary": [c.imag.tolist() for c in v.T]} if is_complex else {})

    return gathered(a, run, "k long, lambda double, vector array<double>" + (", imaginary array<double>" if is_complex else ""))


def _shifted(values: np.ndarray, sigma) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return 1 / (values - sigma)


def eigs(a: Matrix, k: int = 6, which: str = "LM", sigma: complex | None = None) -> DataFrame:
    """``[keys,] k, lambda struct<re, im>`` of general matrices; ``sigma`` as for ``eigsh``."""

    def run(e):
        values = np.linalg.eigvals(e.dense())
        values = values[np.lexsort((values.imag, values.real))]
        at = _pick(values if sigma is None else _shifted(values, sigma), k, which)
        return {"k": np.arange(len(at)), "re": values[at].real, "im": values[at].imag}

    return gathered(a, run, "k long, re double, im double").select(*a.keys, "k", C.of(F.col("re"), F.col("im")).alias("lambda"))


def eigsh_distributed(a: Matrix, k: int = 6, which: str = "LA", maxiter: int = 200, tol: float = 1e-8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """LOBPCG with products over the cluster; the block of vectors is on the driver."""
    values, vectors, _, _ = K.lobpcg(Operator(a), a.n, k, largest=which[0] == "L", tol=tol, maxiter=maxiter, seed=seed)
    return values, _settled(vectors)


def lobpcg(a: Matrix, k: int = 6, largest: bool = True, maxiter: int = 1000, tol: float = 1e-8) -> DataFrame:
    """``[keys,] k, lambda, converged``: iterative, for each matrix in one task."""

    def run(e):
        values, _, _, fine = K.lobpcg(e.matvec, e.n, k, largest=largest, tol=tol, maxiter=maxiter)
        return {"k": np.arange(len(values)), "lambda": values, "converged": fine}

    return gathered(a, run, "k long, lambda double, converged boolean")


def svd(a: Matrix, k: int = 6) -> DataFrame:
    """``[keys,] k, s, u, v``: largest singular values first, with left and right vectors."""

    def run(e):
        u, s, vh = np.linalg.svd(e.dense(), full_matrices=False)
        u, s, vh = u[:, :k], s[:k], vh[:k]
        fixed = _settled(u)
        turn = np.sum(np.conj(u) * fixed, axis=0)
        return {"k": np.arange(len(s)), "s": s, "u": [c.real.tolist() for c in fixed.T], "v": [c.real.tolist() for c in (np.conj(vh).T * turn).T]}

    return gathered(a, run, "k long, s double, u array<double>, v array<double>")


def svd_distributed(a: Matrix, k: int = 6, maxiter: int = 200, tol: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, s, v) for the k largest singular values, with products over the cluster."""
    op = Operator(a)
    return K.subspace_svd(op, op.transposed, a.n, k, maxiter, tol, seed)


def singular_values(a: Matrix) -> DataFrame:
    def run(e):
        s = np.linalg.svd(e.dense(), compute_uv=False)
        return {"k": np.arange(len(s)), "s": s}

    return gathered(a, run, "k long, s double")


def condition_number(a: Matrix, ord=2) -> DataFrame:  # noqa: A002
    """``[keys,] v``: greatest over least singular value, or |A| |A^-1| in another norm."""

    def run(dense):
        with np.errstate(all="ignore"):
            try:
                return [(float(np.linalg.cond(dense, ord)),)]
            except np.linalg.LinAlgError:
                return [(float("inf"),)]

    return dense_apply(a, run, "v double")


def estimated_condition(a: Matrix, steps: int = 20) -> DataFrame:
    """Power iteration for the largest eigenvalue over the least diagonal, for diagnostics."""

    def run(e):
        x = np.random.default_rng(0).standard_normal(e.n)
        for _ in range(steps):
            x = e.matvec(x / np.linalg.norm(x))
        return {"v": [float(np.linalg.norm(x) / max(np.abs(e.diagonal).min(initial=np.inf), 1e-300))]}

    return gathered(a, run, "v double")


def slogdet(a: Matrix) -> DataFrame:
    """``[keys,] sign, logabs``; for complex matrices sign_re, sign_im, logabs."""
    is_complex = a.is_complex

    def run(e):
        sign, log = direct(e).slogdet()
        return {"sign_re": [float(np.real(sign))], "sign_im": [float(np.imag(sign))], "logabs": [float(log)]} if is_complex else {"sign": [float(sign)], "logabs": [float(log)]}

    return gathered(a, run, "sign_re double, sign_im double, logabs double" if is_complex else "sign double, logabs double")


def det(a: Matrix, method: str = "auto", spectral_k: int = 64) -> DataFrame:
    """``[keys,] v``: by factorisation (lu, cholesky), by the least eigenvalues' product (spectral), or component by component.

    auto splits one matrix into its connected components, whose determinants
    multiply. An empty matrix has 1.
    """
    if a.block:
        return block_det(a)
    if method in ("auto", "components") and not a.keys:
        return det_by_components(a)
    if method == "cholesky":
        return dense_apply(a, lambda d: [(float(np.prod(np.diag(np.linalg.cholesky(d)).real ** 2)),)], "v double")
    if method == "spectral":
        return dense_apply(a, lambda d: [(float(np.prod(np.linalg.eigvalsh(d)[:spectral_k])),)], "v double")
    if method not in ("auto", "components", "lu"):
        raise ValueError(f"no method {method!r}")
    out = slogdet(a)
    if a.is_complex:
        return out.select(*a.keys, C.of(F.col("sign_re") * F.exp("logabs"), F.col("sign_im") * F.exp("logabs")).alias("v"))
    return out.select(*a.keys, F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * F.exp("logabs")).alias("v"))


def det_by_components(a: Matrix) -> DataFrame:
    parts = slogdet(a.to_connected_components())
    if a.is_complex:
        angle = F.sum(F.atan2("sign_im", "sign_re"))
        size = F.exp(F.sum("logabs"))
        return parts.agg(C.of(size * F.cos(angle), size * F.sin(angle)).alias("v"))
    sign = F.coalesce(F.product("sign"), F.lit(1.0))
    return parts.agg(F.when(sign == 0, F.lit(0.0)).otherwise(sign * F.exp(F.coalesce(F.sum("logabs"), F.lit(0.0)))).alias("v"))


def block_det(a: Matrix) -> DataFrame:
    """``[keys,] row, col, v``: determinant of every block, in the places of the blocks."""
    @F.pandas_udf("double")
    def dets(flat: pd.Series) -> pd.Series:
        size = int(round(len(flat.iloc[0]) ** 0.5)) if len(flat) else 0
        return pd.Series(np.linalg.det(np.stack(flat.tolist()).reshape(-1, size, size))) if len(flat) else pd.Series([], dtype=float)

    if len(a.block) != 2 or a.block[0] != a.block[1]:
        raise ValueError("square blocks have determinants")
    return a.df.select(*a.keys, "row", "col", dets(F.flatten("val")).alias("v"))


def logdet(a: Matrix, method: str = "auto", probes: int = 20, steps: int = 30, seed: int = 0) -> DataFrame:
    """``[keys,] v``: log |det A|; hutchinson estimates it for positive definite matrices, auto is exact."""
    if method == "hutchinson":

        def run(e):
            return {"v": [K.hutchinson_logdet(e.matvec, e.n, probes, steps, seed)]}

        return gathered(a, run, "v double")
    if method == "cholesky":
        return dense_apply(a, lambda d: [(float(2 * np.sum(np.log(np.diag(np.linalg.cholesky(d)).real))),)], "v double")
    return slogdet(a).select(*a.keys, F.col("logabs").alias("v"))


def logdet_distributed(a: Matrix, probes: int = 20, steps: int = 30, seed: int = 0) -> float:
    """Hutchinson's estimate with products over the cluster."""
    return K.hutchinson_logdet(Operator(a), a.n, probes, steps, seed)


def ratio_of_extremes(a: Matrix) -> DataFrame:
    return singular_values(a).groupBy(*a.keys).agg(ieee.div(F.max("s"), F.min("s")).alias("v"))


bind(eigsh, eigs, lobpcg, svd, svd_distributed, singular_values, condition_number, estimated_condition, slogdet, det, logdet, eigsh_distributed, logdet_distributed)
