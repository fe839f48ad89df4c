"""Choosing how to solve: scoped defaults, presets, memory estimates and a cache."""

from __future__ import annotations

import functools
import threading
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators.direct import GATHER_ENTRIES, solve_info
from ..operators.krylov import residual_norm, solve_distributed

TIERS = {"gather": ("lu", "cholesky", "ldlt", "cg", "mixed_cg", "pipelined_cg", "bicgstab", "gmres", "fgmres", "minres", "lsqr", "lsmr", "amg"), "distributed": ("cg", "pipelined_cg", "bicgstab", "gmres", "fgmres", "minres", "lsqr", "lsmr"), "frames": ("cg",)}
DEFAULTS = {"gather": "lu", "distributed": "cg", "frames": "cg"}
#: Dense factors in one task up to so many unknowns.
DENSE_ROWS = 5000
_local = threading.local()


@dataclass(frozen=True)
class Preconditioner:
    kind: str = "none"
    omega: float = 1.0
    degree: int = 5
    block_size: int = 32

    @classmethod
    def from_string(cls, kind: str) -> Preconditioner:
        return cls(kind)


class _Scoped:
    """Usable as a context and as a decorator; inner scopes win over outer ones."""

    def _stack(self) -> list:
        name = f"stack_{type(self).__name__}"
        if not hasattr(_local, name):
            setattr(_local, name, [])
        return getattr(_local, name)

    def __enter__(self):
        self._stack().append(self)
        return self

    def __exit__(self, *_):
        self._stack().pop()

    def __call__(self, f: Callable) -> Callable:
        @functools.wraps(f)
        def within(*args, **kwargs):
            with self:
                return f(*args, **kwargs)

        return within

    def resolved(self, **given):
        """Fields of the enclosing scopes, then of this one, then those given; None stands for unset."""
        out = {}
        for scope in [*self._stack(), self]:
            out |= {f.name: getattr(scope, f.name) for f in fields(scope) if getattr(scope, f.name) is not None}
        return out | {k: v for k, v in given.items() if v is not None}


@dataclass(frozen=True)
class SolverConfig(_Scoped):
    tier: str | None = None
    method: str | None = None
    preconditioner: str | None = None
    atol: float | None = None
    rtol: float | None = None
    maxiter: int | None = None
    restart: int | None = None

    __call__ = _Scoped.__call__


@dataclass(frozen=True)
class DetConfig(_Scoped):
    method: str | None = None
    probes: int | None = None
    steps: int | None = None
    seed: int | None = None

    __call__ = _Scoped.__call__


@dataclass(frozen=True)
class SolveInfo:
    iterations: int
    residual: float
    converged: bool
    method: str
    tier: str


PRESETS = {
    ("spd", "direct"): SolverConfig("gather", "cholesky"), ("spd", "iterative"): SolverConfig("distributed", "cg", "jacobi"), ("symmetric", "direct"): SolverConfig("gather", "ldlt"), ("symmetric", "iterative"): SolverConfig("distributed", "minres", "none"),
    ("general", "direct"): SolverConfig("gather", "lu"), ("general", "iterative"): SolverConfig("distributed", "gmres", "jacobi"), ("hpd", "direct"): SolverConfig("gather", "cholesky"), ("hermitian", "direct"): SolverConfig("gather", "lu"),
}


def preset(kind: str, form: str) -> SolverConfig:
    if (kind, form) not in PRESETS:
        raise ValueError(f"no preset {kind}/{form}")
    return PRESETS[kind, form]


def high_accuracy(config: SolverConfig, atol: float = 1e-12, rtol: float = 1e-10, maxiter: int = 5000) -> SolverConfig:
    return replace(config, atol=atol, rtol=rtol, maxiter=maxiter)


def auto(a: Matrix) -> SolverConfig:
    """By kind and size: direct in one task while its factors fit, iterative over the cluster beyond."""
    kind = a.matrix_type().first()["kind"]
    form = "direct" if a.m <= DENSE_ROWS else "iterative"
    return PRESETS.get((kind, form), PRESETS["general", form])


def select_tier(n: int, nnz: int) -> str:
    from ..operators.krylov import DRIVER_PLACES

    if nnz <= GATHER_ENTRIES and n <= DENSE_ROWS:
        return "gather"
    return "distributed" if n <= DRIVER_PLACES else "frames"


def select_method(tier: str, is_symmetric: bool = False, is_spd: bool = False) -> str:
    if tier == "gather":
        return "cholesky" if is_spd else "lu"
    return "cg" if is_spd or tier == "frames" else "minres" if is_symmetric else "bicgstab"


def methods(tier: str) -> tuple[str, ...]:
    return TIERS[tier]


def default_method(tier: str) -> str:
    return DEFAULTS[tier]


def available_tiers() -> list[str]:
    return list(TIERS)


def report() -> str:
    return "\n".join(f"{t}: {', '.join(m)}" for t, m in TIERS.items())


def direct_memory(nnz: int, n: int, bytes_each: int = 8) -> int:
    """Bytes of a sparse factor with a fill that grows with n, at most tenfold."""
    fill = min(10, max(2, n // 100))
    return nnz * fill * bytes_each + 10 * n * bytes_each


def solve(a: Matrix, b: DataFrame, **given) -> tuple[DataFrame, SolveInfo]:
    """A x = b by scoped defaults and what is given; returns x (i, v) and how it went."""
    options = SolverConfig().resolved(**given)
    tier = options.pop("tier", None) or select_tier(a.m, a.nnz())
    method = options.pop("method", None)
    if method is None or method == "auto":
        kind = a.matrix_type().first()["kind"]
        method = select_method(tier, kind != "general", kind in ("spd", "hpd"))
    if tier not in TIERS:
        raise ValueError(f"no tier {tier!r}")
    if method not in TIERS[tier]:
        raise ValueError(f"{tier} has no method {method!r}")
    pre = options.pop("preconditioner", None)
    if tier == "gather":
        out = solve_info(a, b, method, pre or "none", **({} if method in ("lu", "cholesky", "ldlt") else options))
        first = out.select("iterations", "residual", "converged").first()
        value = F.struct(F.col("v_re").alias("re"), F.col("v_im").alias("im")) if "v_re" in out.columns else F.col("v")
        return out.select("i", value.alias("v")), SolveInfo(first["iterations"], first["residual"], first["converged"], method, tier)
    if tier == "frames":
        found = a.solve_frames(b, **{k: v for k, v in options.items() if k != "restart"})
    else:
        found = solve_distributed(a, b, method, pre or "jacobi", **options)
    return found.x, SolveInfo(found.iterations, found.residual, found.converged, method, tier)


@dataclass
class Cache:
    """The last few of what was built, by key."""

    size: int = 8
    held: OrderedDict = field(default_factory=OrderedDict)

    def get_or_build(self, key, build: Callable):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        self.held[key] = build()
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return self.held[key]


def fingerprint(a: Matrix) -> tuple:
    """Shape, type and a sum over hashes of all entries."""
    own = a.df.agg(F.count("*"), F.sum(F.xxhash64(*a.df.columns).cast("decimal(38,0)"))).first()
    return a.shape, a.dtype, own[0], own[1]


def verify(a: Matrix, x: DataFrame, b: DataFrame, rtol: float = 1e-6) -> bool:
    size = (b.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) ** 0.5
    return residual_norm(a, x, b) <= rtol * max(size, 1e-300)
