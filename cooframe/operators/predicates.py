"""Structural tests: symmetry, definiteness, kind of matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as C
from ..matrix import Matrix, bind

ATOL, RTOL = 1e-8, 1e-5


def _per_matrix(a: Matrix) -> DataFrame:
    """A row for each element of a batch or list, or one row."""
    if a.sizes is not None:
        return a.sizes.select("matrix_id", (F.col("m") == F.col("n")).alias("square"))
    if a.keys:
        return a.spark.range(a.batch_size).select(F.col("id").alias("batch_id"), F.lit(a.m == a.n).alias("square"))
    return a.spark.range(1).select(F.lit(a.m == a.n).alias("square"))


def _mirrored(a: Matrix, conjugate: bool, atol: float, rtol: float) -> DataFrame:
    """``[keys,] holds``: every place and its mirror are both stored and agree within atol + rtol * |value|."""
    own = a.coalesce().df
    on = [*a.keys, "row", "col"]
    mirror = own.select(*a.keys, F.col("col").alias("row"), F.col("row").alias("col"), F.col("val").alias("_m"))
    v, w = F.col("val"), F.col("_m")
    if a.is_complex:
        w = C.conj(w) if conjugate else w
        gap, size = C.magnitude(C.sub(v, w)), C.magnitude(v)
    else:
        gap, size = F.abs(v - w), F.abs(v)
    fine = F.coalesce((gap <= atol + rtol * size) & ~F.isnan(gap), F.lit(False))
    seen = own.join(mirror, on, "full").groupBy(*a.keys).agg(F.bool_and(F.when(v.isNull() | w.isNull(), False).otherwise(fine)).alias("_ok"))
    per = _per_matrix(a)
    joined = per.join(seen, list(a.keys), "left") if a.keys else per.crossJoin(F.broadcast(seen))  # one row
    return joined.select(*a.keys, (F.col("square") & F.coalesce("_ok", F.lit(True))).alias("holds"))


def is_symmetric(a: Matrix, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    return _mirrored(a, False, atol, rtol)


def is_hermitian(a: Matrix, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    return _mirrored(a, True, atol, rtol)


def gershgorin(a: Matrix) -> DataFrame:
    """``[keys,] holds``: in every row the diagonal is positive and exceeds the sizes beside it; an absent diagonal is 0."""
    own = a.coalesce()
    size = C.magnitude(F.col("val")) if a.is_complex else F.abs("val")
    real = F.col("val.re") if a.is_complex else F.col("val")
    rows = own.df.groupBy(*a.keys, F.col("row").alias("i")).agg(F.sum(F.when(F.col("row") == F.col("col"), real).otherwise(0.0)).alias("d"), F.sum(F.when(F.col("row") != F.col("col"), size).otherwise(0.0)).alias("o"))
    all_ = a.index(0).join(rows, [*a.keys, "i"], "left")
    seen = all_.groupBy(*a.keys).agg(F.bool_and(F.coalesce((F.col("d") > F.col("o")) & (F.col("d") > 0), F.lit(False))).alias("_ok"))
    per = _per_matrix(a)
    joined = per.join(seen, list(a.keys), "left") if a.keys else per.crossJoin(F.broadcast(seen))  # one row
    return joined.select(*a.keys, (F.col("square") & F.coalesce("_ok", F.lit(True))).alias("holds"))


def is_positive_definite(a: Matrix, method: str = "gershgorin") -> DataFrame:
    """gershgorin is sufficient only; cholesky and eigenvalue are exact, by one task for each matrix."""
    if method == "gershgorin":
        return gershgorin(a)
    if method not in ("cholesky", "eigenvalue"):
        raise ValueError(f"no method {method!r}")
    from .direct import dense_apply

    return dense_apply(a, _definite(method), "holds boolean")


def _definite(method: str):
    def test(dense):
        import numpy as np

        if dense.shape[0] != dense.shape[1]:
            return [(False,)]
        if method == "eigenvalue":
            return [(bool((np.linalg.eigvalsh(dense) > 0).all()),)]
        try:
            np.linalg.cholesky(dense)
        except np.linalg.LinAlgError:
            return [(False,)]
        return [(True,)]

    return test


def matrix_type(a: Matrix) -> DataFrame:
    """``[keys,] kind``: general, symmetric, spd, hermitian or hpd; definiteness by Gershgorin, empty matrices are general."""
    on = list(a.keys)
    sym = is_symmetric(a).withColumnRenamed("holds", "s")
    pd = gershgorin(a).withColumnRenamed("holds", "p")
    some = a.df.groupBy(*on).agg(F.count("*").alias("stored"))
    join = (lambda x, y: x.join(y, on, "left")) if on else (lambda x, y: x.crossJoin(F.broadcast(y)))  # one row each
    all_ = join(join(sym, pd), some)
    kind = F.when(F.col("s") & F.col("p"), "spd").when(F.col("s"), "symmetric")
    if a.is_complex:
        all_ = join(all_, is_hermitian(a).withColumnRenamed("holds", "h"))
        kind = F.when(F.col("h") & F.col("p"), "hpd").when(F.col("h"), "hermitian").when(F.col("s"), "symmetric")
    return all_.select(*on, F.when(F.coalesce("stored", F.lit(0)) == 0, "general").otherwise(F.coalesce(kind, F.lit("general"))).alias("kind"))


bind(is_symmetric, is_hermitian, is_positive_definite, matrix_type)
