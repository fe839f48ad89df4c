"""Work on whole matrices in one task each, many side by side; and solving linear systems."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut, drop
from ..functions import complexes as C
from ..kernels.sparse import Entries, direct, pieces, whole
from ..kernels.sparse import solve as kernel_solve
from ..matrix import Matrix, bind

#: Entries of one matrix that a task takes; larger ones go by the distributed methods.
GATHER_ENTRIES = 20_000_000


def _frame(a: Matrix, b: DataFrame | None) -> DataFrame:
    """Entries, right sides and a row with the shape of every matrix: kind 0, 1 and 2."""
    keys = list(a.keys)
    re, im = (F.col("val.re"), F.col("val.im")) if a.is_complex else (F.col("val").cast("double"), F.lit(0.0))
    k0 = F.lit(0).cast("long")
    out = a.df.select(*keys, F.lit(0).alias("kind"), "row", "col", re.alias("re"), im.alias("im"))
    if a.sizes is not None:
        shape = a.sizes.select("matrix_id", F.lit(2).alias("kind"), F.col("m").cast("long").alias("row"), F.col("n").cast("long").alias("col"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    else:
        ids = [F.col("id").alias("batch_id")] if keys else []
        shape = a.spark.range(a.batch_size if keys else 1).select(*ids, F.lit(2).alias("kind"), F.lit(a.m).cast("long").alias("row"), F.lit(a.n).cast("long").alias("col"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    out = out.unionByName(shape)
    if b is not None:
        cplx = b.schema["v"].dataType.simpleString().startswith("struct")
        v = (F.col("v.re"), F.col("v.im")) if cplx else (F.col("v").cast("double"), F.lit(0.0))
        own = [k for k in keys if k in b.columns]
        side = b.select(*own, F.lit(1).alias("kind"), F.col("i").cast("long").alias("row"), (F.col("k").cast("long") if "k" in b.columns else k0).alias("col"), v[0].alias("re"), v[1].alias("im"))
        if len(own) < len(keys):  # one right side for every matrix
            side = side.crossJoin(F.broadcast(shape.select(*keys)))
        out = out.unionByName(side)
    return out


def gathered(a: Matrix, run: Callable, schema: str, b: DataFrame | None = None) -> DataFrame:
    """``run(entries[, b])`` for each matrix, in one task each; it returns columns of ``schema`` by name.

    A matrix beyond GATHER_ENTRIES is refused, in the task that meets it.
    """
    import pandas as pd

    keys, is_complex = list(a.keys), a.is_complex or (b is not None and b.schema["v"].dataType.simpleString().startswith("struct"))
    names = [s.split()[0] for s in schema.split(", ")]
    key_types = ", ".join(f"{k} long" for k in keys)
    sided, most = b is not None, GATHER_ENTRIES

    def task(frame):
        if len(frame) > 2 * most:
            raise ValueError(f"{len(frame)} entries are too many for one task")
        kind = frame["kind"].to_numpy()
        row, col = frame["row"].to_numpy(), frame["col"].to_numpy()
        val = frame["re"].to_numpy() + (1j * frame["im"].to_numpy() if is_complex else 0)
        m, n = int(row[kind == 2][0]), int(col[kind == 2][0])
        on = kind == 0
        e = Entries(row[on], col[on], val[on], m, n)
        if not sided:
            found = run(e)
        else:
            on = kind == 1
            side = np.zeros((m, int(col[on].max(initial=0)) + 1), val.dtype)
            np.add.at(side, (row[on], col[on]), val[on])
            found = run(e, side)
        out = pd.DataFrame(found, columns=names)
        for k in reversed(keys):
            out.insert(0, k, int(frame[k].iloc[0]))
        return out

    frame = _frame(a, b)
    grouped = frame.groupBy(*keys) if keys else frame.withColumn("_one", F.lit(0)).groupBy("_one")
    return grouped.applyInPandas(task, f"{key_types}, {schema}" if keys else schema)


def dense_apply(a: Matrix, f: Callable, schema: str) -> DataFrame:
    """Rows that ``f(dense array)`` returns, for each matrix."""
    names = [s.split()[0] for s in schema.split(", ")]

    def run(e):
        rows = f(e.dense())
        return {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return gathered(a, run, schema)


def parts(name: str, x: np.ndarray, is_complex: bool) -> dict:
    return {f"{name}_re": x.real, f"{name}_im": x.imag} if is_complex else {name: x.real if np.iscomplexobj(x) else x}


def solve(a: Matrix, b: DataFrame, method: str = "auto", preconditioner: str | None = "none", **options) -> DataFrame:
    """``[keys,] i, [k,] v``: A x = b for each matrix, by one task each; ``b`` is [keys,] i, [k,] v.

    lu, cholesky, ldlt are direct: dense up to 2,000 unknowns, beyond that by
    blocks along the levels of the graph; cg, pipelined_cg, bicgstab,
    gmres, fgmres, minres iterate; lsqr and lsmr take rectangular matrices;
    amg is CG with multigrid. A method that does not converge fails. For one
    matrix beyond a task see ``krylov.solve_distributed``.
    """
    out = solve_info(a, b, method, preconditioner, **options)
    value = C.of(F.col("v_re"), F.col("v_im")) if "v_re" in out.columns else F.col("v")
    stop = F.raise_error(F.concat(F.lit("no convergence; the residual is "), F.col("residual").cast("string")))
    return out.select(*a.keys, "i", *(["k"] if "k" in b.columns else []), F.when(~F.col("converged"), stop).otherwise(value).alias("v"))


def solve_info(a: Matrix, b: DataFrame, method: str = "auto", preconditioner: str | None = "none", **options) -> DataFrame:
    """As ``solve``, with iterations, residual, converged and method in every row, and no failure."""
    if not options.get("rectangular") and method not in ("lsqr", "lsmr") and a.sizes is None and a.m != a.n:
        raise ValueError(f"{a.m} x {a.n} is not square")
    is_complex = a.is_complex or b.schema["v"].dataType.simpleString().startswith("struct")

    def run(e, side):
        x, it, size, fine, used = kernel_solve(e, side[:, 0] if side.shape[1] == 1 else side, method, preconditioner, **options)
        x = x.reshape(len(x), -1)
        i, k = np.indices(x.shape)
        return {"i": i.ravel(), "k": k.ravel(), **parts("v", x.ravel(), is_complex), "iterations": it, "residual": size, "converged": fine, "method": used}

    v = "v_re double, v_im double" if is_complex else "v double"
    return gathered(a, run, f"i long, k long, {v}, iterations int, residual double, converged boolean, method string", b)


def solve_batch(a: Matrix, b: DataFrame, method: str = "auto", **options) -> DataFrame:
    """Many systems side by side; the keys of a batch or list say which."""
    return solve(a, b, method, **options)


class Factorised:
    """A matrix with its factor, made once in one task for each matrix and kept as a table of a row for each piece.

    Every solve reads the pieces and the right sides of a matrix together; no
    solve factors again. ``drop`` deletes the table.
    """

    def __init__(self, a: Matrix) -> None:
        self.a = a
        self.keys = list(a.keys)
        made = gathered(a, lambda e: pieces(direct(e)), "piece long, payload binary")
        self.table = cut(made if self.keys else made.withColumn("_one", F.lit(0)))

    def drop(self) -> None:
        drop(self.table)

    def solve(self, b: DataFrame) -> DataFrame:
        return self._solve(b, False)

    def solve_transpose(self, b: DataFrame) -> DataFrame:
        return self._solve(b, True)

    def _solve(self, b: DataFrame, transposed: bool) -> DataFrame:
        import pandas as pd

        a, keys = self.a, self.keys
        if keys and not set(keys) <= set(b.columns):
            raise ValueError(f"right sides name their matrix by {keys}")
        is_complex = a.is_complex or b.schema["v"].dataType.simpleString().startswith("struct")
        v = (F.col("v.re"), F.col("v.im")) if b.schema["v"].dataType.simpleString().startswith("struct") else (F.col("v").cast("double"), F.lit(0.0))
        many = "k" in b.columns
        side = b.select(*keys, F.col("i").cast("long").alias("i"), (F.col("k") if many else F.lit(0)).cast("long").alias("k"), v[0].alias("re"), v[1].alias("im"))
        by = keys or ["_one"]
        side = side if keys else side.withColumn("_one", F.lit(0))

        def task(factor, frame):
            if not len(factor) or not len(frame):
                return pd.DataFrame({**{x: pd.Series(dtype="int64") for x in (*keys, "i", "k")}, "re": pd.Series(dtype=float), "im": pd.Series(dtype=float)})
            own = whole(factor.sort_values("piece")["payload"].tolist())
            names, at = np.unique(frame["k"].to_numpy(), return_inverse=True)
            val = frame["re"].to_numpy() + (1j * frame["im"].to_numpy() if is_complex else 0)
            flat = np.zeros((own.m, len(names)), val.dtype)
            np.add.at(flat, (frame["i"].to_numpy(), at), val)
            x = own.solve(flat, transposed)
            i, j = np.indices(x.shape)
            out = {x_: int(factor[x_].iloc[0]) for x_ in keys} | {"i": i.ravel(), "k": names[j.ravel()], "re": x.real.ravel(), "im": np.imag(x).ravel()}
            return pd.DataFrame(out)

        schema = "".join(f"{x} long, " for x in keys) + "i long, k long, re double, im double"
        found = self.table.groupBy(*by).cogroup(side.groupBy(*by)).applyInPandas(task, schema)
        return found.select(*keys, "i", *(["k"] if many else []), (C.of(F.col("re"), F.col("im")) if is_complex else F.col("re")).alias("v"))

    def solve_chunks(self, chunks: Iterator[DataFrame]) -> Iterator[DataFrame]:
        for b in chunks:
            yield self.solve(b)


def lu(a: Matrix) -> Factorised:
    return Factorised(a)


def least_squares(a: Matrix, b: DataFrame, method: str = "lsqr", **options) -> DataFrame:
    return solve(a, b, method, **options)


def lsqr(a: Matrix, b: DataFrame, **options) -> DataFrame:
    return solve(a, b, "lsqr", **options)


def lsmr(a: Matrix, b: DataFrame, **options) -> DataFrame:
    return solve(a, b, "lsmr", **options)


bind(solve, solve_info, solve_batch, lu, least_squares, lsqr, lsmr)
