"""The sparse matrix: a DataFrame of stored entries with its shape."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import complexes as C
from .functions import ieee
from .sizes import spread


_ONE = object()  # stands for the second value of a step that takes one


class Matrix:
    """Stored entries ``[keys,] row, col, val`` of one matrix, of a batch or of a list.

    ``keys`` is () for one matrix, ("batch_id",) for a batch, whose elements
    have one shape, and ("matrix_id",) for a list, whose shapes are rows of
    ``sizes`` (matrix_id, m, n). Every operation groups and joins by the keys,
    so all forms share one plan. ``val`` is a number, a boolean, a
    struct<re, im> or, with ``block``, an array of arrays.

    Entries may repeat; unless ``coalesced`` is true, operations that need one
    entry a place add them up first. Stored zeros are kept.
    """

    def __init__(self, df: DataFrame, m: int | None = None, n: int | None = None, keys: Sequence[str] = (), sizes: DataFrame | None = None, batch: Sequence[int] = (), block: Sequence[int] = (), coalesced: bool = False) -> None:
        self.df, self.m, self.n, self.keys = df, m, n, tuple(keys)
        self.sizes, self.batch, self.block, self.coalesced = sizes, tuple(batch), tuple(block), coalesced
        self._root, self._steps = self, ()
        if self.keys not in ((), ("batch_id",), ("matrix_id",)):
            raise ValueError(f"keys {self.keys}: none, batch_id or matrix_id")
        if self.keys == ("matrix_id",):
            if sizes is None:
                raise ValueError("a list of matrices needs its sizes")
        elif m is None or n is None or m < 0 or n < 0:
            raise ValueError("a matrix needs its shape")
        if self.keys == ("batch_id",) and not self.batch:
            raise ValueError("a batch needs its batch shape")
        missing = {*self.keys, "row", "col", "val"} - set(df.columns)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")

    # -- construction --------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, row: str, col: str, val: str | Column, m: int, n: int, agg: Callable[[Column], Column] | None = F.sum) -> Matrix:
        """From any table: ``agg`` joins the rows of one place into an entry (None: they stay as they are)."""
        value = F.col(val) if isinstance(val, str) else val
        out = df.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), value.alias("val"))
        if agg:
            out = spread(out, "row", "col").groupBy("row", "col").agg(agg(F.col("val")).alias("val"))
        return cls(out, m, n, coalesced=agg is not None)

    @classmethod
    def from_arrays(cls, spark: SparkSession, values, rows, cols, shape: Sequence[int]) -> Matrix:
        """From arrays on the driver; complex values become structs."""
        if any(isinstance(v, complex) for v in values):
            data = [(int(r), int(c), (float(complex(v).real), float(complex(v).imag))) for r, c, v in zip(rows, cols, values)]
            kind = C.TYPE
        else:
            data, kind = [(int(r), int(c), float(v)) for r, c, v in zip(rows, cols, values)], "double"
        return cls(spark.createDataFrame(data, f"row long, col long, val {kind}"), *shape)

    @classmethod
    def from_dense(cls, spark: SparkSession, a) -> Matrix:
        """From a dense array of two or more axes, without its exact zeros; leading axes are a batch with the union of patterns."""
        import numpy as np

        a = np.asarray(a)
        if a.ndim < 2:
            raise ValueError("a matrix has two axes")
        flat = a.reshape(-1, *a.shape[-2:])
        rows, cols = np.nonzero((flat != 0).any(0))
        plain = (lambda v: (float(v.real), float(v.imag))) if np.iscomplexobj(a) else float
        kind = C.TYPE if np.iscomplexobj(a) else "double"
        if a.ndim == 2:
            data = [(int(r), int(c), plain(flat[0, r, c])) for r, c in zip(rows, cols)]
            return cls(spark.createDataFrame(data, f"row long, col long, val {kind}"), *a.shape, coalesced=True)
        data = [(k, int(r), int(c), plain(flat[k, r, c])) for k in range(len(flat)) for r, c in zip(rows, cols)]
        return cls(spark.createDataFrame(data, f"batch_id long, row long, col long, val {kind}"), *a.shape[-2:], keys=("batch_id",), batch=a.shape[:-2], coalesced=True)

    @classmethod
    def from_dense_rows(cls, df: DataFrame, row: str, values: str, m: int, n: int) -> Matrix:
        """From a table with an array of values for each row, without exact zeros."""
        out = df.select(F.col(row).cast("long").alias("row"), F.posexplode(values).alias("col", "val"))
        return cls(out.select("row", F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val")).where("val <> 0"), m, n, coalesced=True)

    @classmethod
    def from_csr(cls, df: DataFrame, m: int, n: int) -> Matrix:
        """From ``row, cols, vals``, as ``to_csr`` gives them."""
        pairs = df.select(F.col("row").cast("long").alias("row"), F.explode(F.arrays_zip("cols", "vals")).alias("e"))
        return cls(pairs.select("row", F.col("e.cols").cast("long").alias("col"), F.col("e.vals").alias("val")), m, n)

    @classmethod
    def coerce(cls, spark: SparkSession, x, shape: Sequence[int] | None = None) -> Matrix:
        """A matrix from a matrix, (values, rows, columns, shape), a dense array, entries with a shape, or a function probed column by column."""
        if isinstance(x, Matrix):
            return x
        if isinstance(x, DataFrame):
            return cls(x, *shape)
        if isinstance(x, tuple) and len(x) == 4:
            return cls.from_arrays(spark, *x)
        if callable(x):
            import numpy as np

            return cls.from_dense(spark, np.stack([np.asarray(x(e)) for e in np.eye(shape[1])], axis=1))
        return cls.from_dense(spark, x)

    @classmethod
    def list_of(cls, matrices: Sequence[Matrix]) -> Matrix:
        """A list of single matrices, numbered from 0."""
        if not matrices:
            raise ValueError("a list of matrices is not empty")
        spark = matrices[0].spark
        df = None
        for k, a in enumerate(matrices):
            part = a.df.select(F.lit(k).cast("long").alias("matrix_id"), "row", "col", "val")
            df = part if df is None else df.unionByName(part)
        sizes = spark.createDataFrame([(k, a.m, a.n) for k, a in enumerate(matrices)], "matrix_id long, m long, n long")
        return cls(df, keys=("matrix_id",), sizes=sizes, coalesced=all(a.coalesced for a in matrices))

    def derived(self, df: DataFrame, **changes) -> Matrix:
        have = dict(m=self.m, n=self.n, keys=self.keys, sizes=self.sizes, batch=self.batch, block=self.block, coalesced=self.coalesced)
        return Matrix(df, **(have | changes))

    # -- description ---------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def shape(self) -> tuple[int, ...]:
        return (*self.batch, self.m, self.n, *self.block)

    @property
    def sparse_shape(self) -> tuple[int, int]:
        return self.m, self.n

    @property
    def batch_size(self) -> int:
        return math.prod(self.batch)

    @property
    def is_square(self) -> bool:
        if self.sizes is not None:
            return self.sizes.where("m <> n").isEmpty()
        return self.m == self.n

    @property
    def is_complex(self) -> bool:
        return self.dtype.startswith("struct")

    @cached_property
    def dtype(self) -> str:
        return self.df.schema["val"].dataType.simpleString()

    def nnz(self) -> int:
        """Stored entries, repeated ones and zeros included; of one element of a batch."""
        rows = self.df.count()
        return rows // self.batch_size if self.batch else rows

    def shapes(self) -> DataFrame:
        return self.sizes

    def total_shape(self) -> tuple[int, int]:
        r = self.sizes.agg(F.sum("m"), F.sum("n")).first()
        return r[0], r[1]

    def index(self, axis: int, name: str = "i") -> DataFrame:
        """Every place along an axis: ``[keys,] i``."""
        if self.sizes is not None:
            size = F.col("m" if axis == 0 else "n")
            return self.sizes.where(size > 0).select("matrix_id", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias(name))
        size = self.m if axis == 0 else self.n
        if not self.keys:
            return self.spark.range(size).select(F.col("id").alias(name))
        ids = self.spark.range(self.batch_size * size)
        return ids.select(F.floor(F.col("id") / max(1, size)).alias("batch_id"), (F.col("id") % max(1, size)).alias(name))

    # -- forms ---------------------------------------------------------------

    def coalesce(self) -> Matrix:
        """One entry a place; repeated ones are added up."""
        if self.coalesced:
            return self
        value = C.total(F.col("val")) if self.is_complex else F.sum("val")
        return self.derived(spread(self.df, *self.keys, "row", "col").groupBy(*self.keys, "row", "col").agg(value.alias("val")), coalesced=True)

    def map(self, f: Callable[[Column], Column], keep_places: bool = True) -> Matrix:
        """A function of every stored value; absent places stay absent."""
        out = self.derived(self.df.select(*self.keys, "row", "col", f(F.col("val")).alias("val")))
        out._root, out._steps = self._root, (*self._steps, (object(), f, self._last, _ONE))
        return out

    @property
    def _last(self):
        """The value that this matrix holds, among those that its steps work out from its root's."""
        return self._steps[-1][0] if self._steps else None

    def zipped(self, other: Matrix, f: Callable[[Column, Column], Column]) -> Matrix | None:
        """``f`` of both values of each place where both come from the entries of one matrix, without a join; None elsewhere.

        Each step of either is a column of its own, so a value that several
        steps take is worked out once and the plan grows by the steps.
        """
        root = self._root
        if root is not other._root or not (root.coalesced and self.coalesced and other.coalesced):
            return None
        steps = (*self._steps, *(s for s in other._steps if s not in self._steps), (object(), f, self._last, other._last))
        names = {None: "val"} | {key: f"_{k}" for k, (key, *_) in enumerate(steps)}
        df = root.df.select(*root.keys, "row", "col", "val")
        for key, g, a, b in steps:
            df = df.withColumn(names[key], g(F.col(names[a])) if b is _ONE else g(F.col(names[a]), F.col(names[b])))
        out = self.derived(df.select(*root.keys, "row", "col", F.col(names[steps[-1][0]]).alias("val")))
        out._root, out._steps = root, steps
        return out

    def cast(self, kind: str) -> Matrix:
        if kind in ("half", "float16"):
            raise ValueError("there is no half-precision type; take float")
        return self.map(lambda v: v.cast(kind))

    def float(self) -> Matrix:
        return self.cast("float")

    def double(self) -> Matrix:
        return self.cast("double")

    @property
    def T(self) -> Matrix:
        """Transpose: a projection."""
        sizes = self.sizes.select("matrix_id", F.col("n").alias("m"), F.col("m").alias("n")) if self.sizes is not None else None
        return self.derived(self.df.select(*self.keys, F.col("col").alias("row"), F.col("row").alias("col"), "val"), m=self.n, n=self.m, sizes=sizes)

    def conj(self) -> Matrix:
        return self.map(C.conj) if self.is_complex else self

    @property
    def H(self) -> Matrix:
        return self.T.conj()

    def element(self, k: int) -> Matrix:
        """One element of a batch or list; a list also counts from its end."""
        if self.sizes is not None:
            if k < 0:
                k += self.sizes.count()
            size = self.sizes.where(F.col("matrix_id") == k).first()
            if size is None:
                raise IndexError(k)
            return Matrix(self.df.where(F.col("matrix_id") == k).drop("matrix_id"), size["m"], size["n"], coalesced=self.coalesced)
        return Matrix(self.df.where(F.col("batch_id") == k).drop("batch_id"), self.m, self.n, block=self.block, coalesced=self.coalesced)

    def to_numpy(self):
        """Dense array on the driver, for matrices that fit there."""
        import numpy as np

        if (self.m or 0) * (self.n or 0) > 1 << 27:
            raise ValueError(f"a dense array of {self.m} x {self.n} does not fit the driver")
        shape = (self.batch_size, self.m, self.n) if self.keys else (1, self.m, self.n)
        out = np.zeros(shape, complex if self.is_complex else float)
        for r in self.df.collect():
            v = complex(r["val"]["re"], r["val"]["im"]) if self.is_complex else r["val"]
            out[r["batch_id"] if self.keys else 0, r["row"], r["col"]] += v
        return out.reshape(self.shape) if self.keys else out[0]

    def to_csr(self) -> DataFrame:
        """``[keys,] row, cols, vals``: a row of arrays for each row that holds entries, in column order."""
        entries = F.sort_array(F.collect_list(F.struct("col", "val")))
        return self.coalesce().df.groupBy(*self.keys, "row").agg(entries.alias("e")).select(*self.keys, "row", F.col("e.col").alias("cols"), F.col("e.val").alias("vals"))

    def spy(self) -> DataFrame:
        """``[keys,] row, col, shade``: size of each value against the largest."""
        own = self.abs().df
        top = own.groupBy(*self.keys).agg(F.max("val").alias("top"))
        joined = own.join(top, list(self.keys)) if self.keys else own.crossJoin(F.broadcast(top))  # one row
        return joined.select(*self.keys, "row", "col", ieee.div(F.col("val"), F.col("top")).alias("shade"))

    def abs(self) -> Matrix:
        return self.map(C.magnitude if self.is_complex else F.abs)


def bind(*functions) -> None:
    """Make operator functions methods of Matrix, under their own names."""
    for f in functions:
        setattr(Matrix, f.__name__, f)
