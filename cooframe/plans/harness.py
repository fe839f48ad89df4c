"""Cases with known solutions, and how far a solver is from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators.krylov import to_frame
from ..sources import generators


@dataclass(frozen=True)
class Case:
    x: DataFrame
    b: DataFrame


@dataclass(frozen=True)
class Benchmark:
    """A matrix, what is known of it, and cases (x, b = A x) that a seed determines."""

    name: str
    a: Matrix
    kind: str
    cases: tuple[Case, ...]

    @classmethod
    def random(cls, name: str, a: Matrix, kind: str = "general", n_cases: int = 3, seed: int = 0) -> Benchmark:
        rng = np.random.default_rng(seed)
        made = []
        for _ in range(n_cases):
            x = to_frame(a.spark, rng.standard_normal(a.n))
            made.append(Case(x, a.matvec(x)))
        return cls(name, a, kind, tuple(made))

    def evaluate(self, solver: Callable[[Matrix, DataFrame], DataFrame], metric: str | Callable = "rel_l2") -> list[float]:
        """rel_l2, max_abs or a function of two vectors, for each case."""
        return [error(solver(self.a, c.b), c.x, metric) for c in self.cases]


def error(found: DataFrame, exact: DataFrame, metric: str | Callable = "rel_l2") -> float:
    if callable(metric):
        return float(metric(found, exact))
    both = exact.select("i", F.col("v").alias("_x")).join(found.select("i", "v"), "i", "left")
    gap = F.coalesce(F.col("v"), F.lit(0.0)) - F.col("_x")
    if metric == "rel_l2":
        r = both.agg(F.sum(gap * gap), F.sum(F.col("_x") * F.col("_x"))).first()
        return (r[0] / r[1]) ** 0.5 if r[1] else float(r[0] or 0) ** 0.5
    if metric == "max_abs":
        return float(both.agg(F.max(F.abs(gap))).first()[0])
    raise ValueError(f"no metric {metric!r}")


def benchmarks(spark: SparkSession, kinds: tuple[str, ...] | None = None) -> Iterator[Benchmark]:
    for name, kind in (("laplacian_1d", "spd"), ("laplacian_2d", "spd"), ("anisotropic_2d", "spd"), ("advection_diffusion_2d", "general")):
        if kinds is None or kind in kinds:
            yield Benchmark.random(name, generators.get(spark, name, **generators.default_sizes(name)[0]), kind)
