"""One large matrix: Krylov methods whose products run over the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..kernels import krylov as K
from ..matrix import Matrix, bind
from .products import dot, matvec
from .reductions import diagonal

#: Vectors of up to so many places stay on the driver and are broadcast (a vector of 20 million is 160 MB); longer ones are DataFrames.
DRIVER_PLACES = 20_000_000


@dataclass(frozen=True)
class Solution:
    x: DataFrame
    iterations: int
    residual: float
    converged: bool
    method: str


class Operator:
    """A matrix over the cluster as a function of driver vectors.

    Entries are written once, exchanged by ranges of rows and packed into
    arrays, one for each task; a product is one job that broadcasts x and
    returns each task's own rows. The rows of a task are its alone, so nothing
    is exchanged, and what comes back is one vector.
    """

    def __init__(self, a: Matrix, tasks: int | None = None) -> None:
        if a.keys or a.is_complex:
            raise ValueError("one real matrix")
        if max(a.m, a.n) > DRIVER_PLACES:
            raise ValueError(f"vectors of {max(a.m, a.n)} places are not for the driver; use solve_frames")
        self.a, self.m, self.n = a, a.m, a.n
        self.forward = self._packed(a, tasks)
        self._backward: DataFrame | None = None

    @staticmethod
    def _packed(a: Matrix, tasks: int | None) -> DataFrame:
        tasks = tasks or int(a.spark.conf.get("spark.sql.shuffle.partitions"))
        size = max(1, -(-a.m // tasks))
        own = a.coalesce().df.select(F.floor(F.col("row") / size).alias("part"), "row", "col", F.col("val").cast("double").alias("val"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.large_binary()).cast(pa.binary()) for c in cols], ["row", "col", "val"])

        return cut(own.repartition(tasks, "part").sortWithinPartitions("row", "col").mapInArrow(pack, "row binary, col binary, val binary"))

    def _product(self, packed: DataFrame, x: np.ndarray, size: int) -> np.ndarray:
        wide = x.reshape(len(x), -1)
        width = wide.shape[1]
        sent = self.a.spark.sparkContext.broadcast(wide)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vector = sent.value
            for batch in batches:
                for r, c, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    row, col, val = np.frombuffer(r, np.int64), np.frombuffer(c, np.int64), np.frombuffer(v)
                    first = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
                    total = np.add.reduceat(val[:, None] * vector[col], first, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([row[first].tobytes()]), pa.array([total.tobytes()])], ["row", "v"])

        out = np.zeros((size, width))
        for r in packed.mapInArrow(run, "row binary, v binary").toLocalIterator(prefetchPartitions=True):
            np.add.at(out, np.frombuffer(r["row"], np.int64), np.frombuffer(r["v"]).reshape(-1, width))
        sent.destroy()
        return out.reshape((size, *x.shape[1:]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._product(self.forward, x, self.m)

    def transposed(self, x: np.ndarray) -> np.ndarray:
        if self._backward is None:
            self._backward = self._packed(self.a.T, None)
        return self._product(self._backward, x, self.n)


def to_driver(x: DataFrame, n: int) -> np.ndarray:
    """A vector (i, v) as an array; refused beyond DRIVER_PLACES."""
    if n > DRIVER_PLACES:
        raise ValueError(f"a vector of {n} places is not for the driver")
    t = x.select("i", F.col("v").cast("double").alias("v")).toArrow()
    out = np.zeros(n)
    out[t["i"].to_numpy()] = t["v"].to_numpy()
    return out


def to_frame(spark, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"i": np.arange(len(x)), "v": np.asarray(x, float)}))


def preconditioner(a: Matrix, op: Operator, name: str | None, **options):
    """none, jacobi, jacobi_l1 or polynomial over the cluster; the others need a matrix in one task."""
    if name in (None, "none"):
        return None
    if callable(name):
        return name
    if name in ("jacobi", "auto"):
        d = to_driver(diagonal(a), a.m)
        return lambda r: r / np.where(np.abs(d) < 1e-14, 1, d)
    if name == "jacobi_l1":
        d = to_driver(a.abs().sum(1), a.m)
        return lambda r: r / np.maximum(d, 1e-300)
    if name == "polynomial":
        d = to_driver(diagonal(a), a.m)
        d = 1 / np.where(np.abs(d) < 1e-14, 1, d)

        def apply(r):
            out = term = r
            for _ in range(options.get("degree", 2)):
                term = term - op(d * term)
                out = out + term
            return d * out

        return apply
    raise ValueError(f"no distributed preconditioner {name!r}")


def solve_distributed(a: Matrix, b: DataFrame, method: str = "cg", preconditioner_: str | None = "jacobi", **options) -> Solution:
    """One system whose matrix is spread over the cluster and whose vectors fit the driver; frames beyond that."""
    if max(a.m, a.n) > DRIVER_PLACES:
        return solve_frames(a, b, **{k: v for k, v in options.items() if k in ("atol", "rtol", "maxiter")})
    op = Operator(a)
    side = to_driver(b, a.m)
    if method in K.LEAST_SQUARES:
        x, it, size, fine = K.LEAST_SQUARES[method](op, op.transposed, side, a.n, **options)
    elif method in K.METHODS:
        x, it, size, fine = K.METHODS[method](op, side, preconditioner(a, op, preconditioner_), **options)
    else:
        raise ValueError(f"no method {method!r}")
    return Solution(to_frame(a.spark, x), it, size, fine, method)


def solve_frames(a: Matrix, b: DataFrame, atol: float = 1e-10, rtol: float = 1e-6, maxiter: int = 1000, places: int = 0) -> Solution:
    """Jacobi-preconditioned CG with every vector a DataFrame: nothing grows on the driver, one written table a step."""
    d = diagonal(a).withColumn("d", F.when(F.abs("v") < 1e-14, F.lit(1.0)).otherwise(F.col("v"))).select("i", "d")
    state = cut(b.join(d, "i").select("i", "d", F.lit(0.0).alias("x"), F.col("v").alias("r"), (F.col("v") / F.col("d")).alias("p")))
    rz, rr = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
    goal, it = max(atol, rtol * (rr or 0.0) ** 0.5), 0
    while (rr or 0.0) ** 0.5 > goal and it < maxiter:
        q = matvec(a, state.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "q")
        step = cut(state.join(q, "i"))
        alpha = rz / step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = step.select("i", "d", "p", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"))
        new, rr = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
        state = cut(moved.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p")))
        rz = new
        it += 1
    return Solution(state.select("i", F.col("x").alias("v")), it, (rr or 0.0) ** 0.5, (rr or 0.0) ** 0.5 <= goal, "cg")


def residual_norm(a: Matrix, x: DataFrame, b: DataFrame) -> float:
    """|b - A x|."""
    gap = matvec(a, x).join(b.select("i", F.col("v").alias("_b")), "i").select("i", (F.col("_b") - F.col("v")).alias("v"))
    return (dot(gap, gap).first()["v"] or 0.0) ** 0.5


bind(solve_distributed, solve_frames)
