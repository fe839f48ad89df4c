"""Products as joins: matrix by vector, by vectors, by matrix; Kronecker; lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as C
from ..matrix import Matrix, bind
from . import blocks
from .reductions import filled

#: A vector of up to so many values is sent whole to every task; a longer one is joined by exchange.
BROADCAST_ROWS = 1_000_000


def _sized(x: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(x) if rows is not None and rows <= BROADCAST_ROWS else x


def matvec(a: Matrix, x: DataFrame) -> DataFrame:
    """``[keys,] i, [k,] v`` of A x for ``x`` ([keys,] i, [k,] v), zeros included.

    A vector without the keys of a batch or list serves all its elements. With
    a column ``k`` the vectors are many; every k of ``x`` has a full result.
    """
    on = [k for k in a.keys if k in x.columns]
    many = "k" in x.columns
    renamed = x.select(*on, F.col("i").alias("col"), *(["k"] if many else []), F.col("v").alias("_x"))
    length = a.n * (a.batch_size if on else 1) if a.n is not None and not many else None
    joined = a.df.join(_sized(renamed, length), [*on, "col"])
    cplx = a.is_complex or x.schema["v"].dataType.simpleString().startswith("struct")
    v, w = F.col("val"), F.col("_x")
    if cplx:
        v = v if a.is_complex else C.of(v)
        w = w if x.schema["v"].dataType.simpleString().startswith("struct") else C.of(w)
    value = C.total(C.mul(v, w)) if cplx else F.sum(v * w)
    by = [*a.keys, F.col("row").alias("i"), *(["k"] if many else [])]
    found = joined.groupBy(*by).agg(value.alias("v"))
    if not many:
        return filled(a, 0, found)
    ks = x.select(*on, "k").distinct()
    all_ = a.index(0).join(ks, on) if on else a.index(0).crossJoin(ks)  # the shape of the dense result
    names = [*a.keys, "i", "k"]
    zero = C.of(0.0, 0.0) if cplx else F.lit(0.0)
    return all_.join(found, names, "left").select(*names, F.coalesce("v", zero).alias("v"))


def rmatvec(a: Matrix, x: DataFrame) -> DataFrame:
    """x A, by the transpose's plan."""
    return matvec(a.T, x)


def matmul(a: Matrix, b: Matrix) -> Matrix:
    """A B with one entry a place; terms that cancel stay as zeros.

    Rows of B that no column of A meets never leave the join; both sides are
    added up first, which bounds the products of a place by its distinct pairs.
    Large matrices of doubles are multiplied by blocks of rows instead.
    """
    if a.sizes is None and b.sizes is None and a.n != b.m:
        raise ValueError(f"shapes {a.shape} and {b.shape} do not multiply")
    if blocks.fit(a, b):
        return a.derived(blocks.product(blocks.settled(a), blocks.settled(b)), n=b.n, coalesced=True)
    on = [k for k in a.keys if k in b.keys]
    left, right = a.coalesce(), b.coalesce()
    x = left.df.select(*a.keys, "row", F.col("col").alias("_k"), F.col("val").alias("_a"))
    y = right.df.select(*on, F.col("row").alias("_k"), "col", F.col("val").alias("_b"))
    cplx = a.is_complex or b.is_complex
    p, q = F.col("_a"), F.col("_b")
    if cplx:
        p, q = (p if a.is_complex else C.of(p)), (q if b.is_complex else C.of(q))
    value = C.total(C.mul(p, q)) if cplx else F.sum(p * q)
    out = x.join(y, [*on, "_k"]).groupBy(*a.keys, "row", "col").agg(value.alias("val"))
    sizes = None
    if a.sizes is not None:
        sizes = a.sizes.select("matrix_id", "m").join(b.sizes.select("matrix_id", "n"), "matrix_id") if b.sizes is not None else a.sizes.select("matrix_id", "m", F.lit(b.n).cast("long").alias("n"))
    return a.derived(out, n=b.n, sizes=sizes, coalesced=True)


def gram(a: Matrix) -> Matrix:
    """A A^H."""
    if blocks.fit(a):
        a = blocks.settled(a)  # both factors read the one table
    return matmul(a, a.H)


def chain(matrices: list[Matrix], x: DataFrame) -> DataFrame:
    """A1 (A2 (... x)): from the right, so no product of matrices is formed."""
    for a in reversed(matrices):
        x = matvec(a, x)
    return x


def kron(a: Matrix, b: Matrix) -> Matrix:
    """Kronecker product; the result itself has an entry for every pair of entries."""
    x = a.coalesce().df.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("val").alias("_v"))
    both = x.crossJoin(b.coalesce().df)
    out = both.select((F.col("_r") * b.m + F.col("row")).alias("row"), (F.col("_c") * b.n + F.col("col")).alias("col"), (F.col("_v") * F.col("val")).alias("val"))
    return Matrix(out, a.m * b.m, a.n * b.n, coalesced=True)


def gather_at(a: Matrix, places: DataFrame) -> DataFrame:
    """``places`` ([keys,] row, col) with ``v``: the value there, zero where absent."""
    own = a.coalesce().df.withColumnRenamed("val", "v")
    zero = C.of(0.0, 0.0) if a.is_complex else F.lit(0.0)
    return places.join(own, [*a.keys, "row", "col"], "left").withColumn("v", F.coalesce("v", zero))


def matmul_at(a: Matrix, b: Matrix, places: DataFrame, by: str = "right") -> DataFrame:
    """``places`` ([keys,] row, col, each once) with ``v``: the product A B there and nowhere else.

    Each place meets the entries of B in its column (``by`` right) or of A in
    its row (left), and looks up the other factor: the work is that of a
    product with the pattern, however many entries the other factor has.
    Large matrices of doubles are taken by blocks of the places' rows (right) or
    columns (left), so that no table of all meetings crosses the network.
    """
    if blocks.fit(a, b) and set(places.columns) == {"row", "col"}:
        if by == "right":
            return blocks.product_at(a, blocks.settled(b), places, a.m)
        turned = places.select(F.col("col").alias("row"), F.col("row").alias("col"))
        return blocks.product_at(b.T, blocks.settled(a).T, turned, b.n).select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
    on = [k for k in a.keys if k in b.keys]
    x = a.coalesce().df.select(*a.keys, "row", F.col("col").alias("_k"), F.col("val").alias("_a"))
    y = b.coalesce().df.select(*on, F.col("row").alias("_k"), "col", F.col("val").alias("_b"))
    keys = [*a.keys, "row", "col"]
    wide = places.join(y, [*on, "col"]).join(x, [*a.keys, "row", "_k"]) if by == "right" else places.join(x, [*a.keys, "row"]).join(y, [*on, "_k", "col"])
    cplx = a.is_complex or b.is_complex
    p, q = F.col("_a"), F.col("_b")
    if cplx:
        p, q = (p if a.is_complex else C.of(p)), (q if b.is_complex else C.of(q))
    found = wide.groupBy(*keys).agg((C.total(C.mul(p, q)) if cplx else F.sum(p * q)).alias("v"))
    zero = C.of(0.0, 0.0) if cplx else F.lit(0.0)
    return places.join(found, keys, "left").withColumn("v", F.coalesce("v", zero))


def lower(a: Matrix, strict: bool = True) -> Matrix:
    return a.derived(a.df.where("row > col" if strict else "row >= col"))


def upper(a: Matrix, strict: bool = True) -> Matrix:
    return a.derived(a.df.where("row < col" if strict else "row <= col"))


def plus(a: Matrix, b: Matrix) -> Matrix:
    """Sum over the union of patterns."""
    return a.derived(a.df.unionByName(b.df), coalesced=False).coalesce()


def dot(x: DataFrame, y: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``[keys,] v``: inner product of vectors by place."""
    other = y.select(*keys, "i", F.col("v").alias("_y"))
    return x.join(other, [*keys, "i"]).groupBy(*keys).agg(F.sum(F.col("v") * F.col("_y")).alias("v"))


def vector_norm(x: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return x.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))


def __matmul__(a: Matrix, b):
    return matmul(a, b) if isinstance(b, Matrix) else matvec(a, b)


def __rmatmul__(a: Matrix, x: DataFrame):
    return rmatvec(a, x)


bind(matvec, rmatvec, matmul, matmul_at, gram, kron, gather_at, lower, upper, plus, __matmul__, __rmatmul__)
