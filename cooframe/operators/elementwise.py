"""Elementwise arithmetic, functions and comparisons of stored values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import complexes as C
from ..functions import ieee
from ..matrix import Matrix, bind


def combine(a: Matrix, other, real: Callable[[Column, Column], Column], cplx: Callable[[Column, Column], Column] | None = None) -> Matrix:
    """Entry by entry with a number, or with a matrix of the same pattern.

    Patterns are compared in the join that combines them: one full outer join,
    which fails on the first place that only one side has. Two that were worked
    out from the entries of one matrix have its pattern and need no join.
    """
    if isinstance(other, Matrix):
        if (a.keys, a.m, a.n) != (other.keys, other.m, other.n):
            raise ValueError(f"shapes {a.shape} and {other.shape} differ")
        left, right = a.coalesce(), other.coalesce()

        def value(p, q):
            if left.is_complex != right.is_complex:
                p, q = (p if left.is_complex else C.of(p)), (q if right.is_complex else C.of(q))
            return _pick(a.is_complex or other.is_complex, real, cplx)(p, q)

        if (out := left.zipped(right, value)) is not None:
            return out
        on = [*a.keys, "row", "col"]
        x = left.df.select(*on, F.col("val").alias("_x"), F.lit(True).alias("_l"))
        y = right.df.select(*on, F.col("val").alias("_y"), F.lit(True).alias("_r"))
        both = x.join(y, on, "full")
        differ = F.raise_error(F.concat(F.lit("the patterns differ at row "), F.col("row"), F.lit(", column "), F.col("col")))
        return left.derived(both.select(*on, F.when(F.col("_l").isNull() | F.col("_r").isNull(), differ).otherwise(value(F.col("_x"), F.col("_y"))).alias("val")))
    if isinstance(other, complex) or a.is_complex:
        own = a if a.is_complex else a.map(C.of)
        f = _pick(True, real, cplx)
        return own.map(lambda v: f(v, C.literal(complex(other))))
    return a.map(lambda v: real(v, F.lit(other)))


def _pick(is_complex: bool, real, cplx):
    if is_complex and cplx is None:
        raise TypeError("not defined for complex values")
    return cplx if is_complex else real


def add(a, b):
    return combine(a, b, lambda x, y: x + y, C.add)


def sub(a, b):
    return combine(a, b, lambda x, y: x - y, C.sub)


def rsub(a, b):
    return combine(a, b, lambda x, y: y - x, lambda x, y: C.sub(y, x))


def mul(a, b):
    """Hadamard product, or scaling."""
    return combine(a, b, lambda x, y: x * y, C.mul)


def _cdiv(x, y):
    size = y["re"] * y["re"] + y["im"] * y["im"]
    z = C.mul(x, C.conj(y))
    return C.of(ieee.div(z["re"], size), ieee.div(z["im"], size))


def truediv(a, b):
    return combine(a, b, ieee.div, _cdiv)


def rtruediv(a, b):
    return combine(a, b, lambda x, y: ieee.div(y, x), lambda x, y: _cdiv(y, x))


def floordiv(a, b):
    return combine(a, b, ieee.floordiv)


def pow(a, b):  # noqa: A001
    return combine(a, b, lambda x, y: F.pow(x.cast("double"), y))


def neg(a):
    return a.map(C.neg if a.is_complex else lambda v: -v)


def pos(a):
    return a


UNARY = {
    "sqrt": ieee.sqrt, "square": lambda v: v * v, "exp": F.exp, "log": ieee.ln, "log10": ieee.log10, "log2": ieee.log2, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "sigmoid": ieee.sigmoid, "relu": ieee.relu, "sign": ieee.sign, "floor": ieee.floor, "ceil": ieee.ceil, "round": ieee.round_even, "reciprocal": lambda v: ieee.div(1.0, v),
    "isnan": lambda v: F.isnan(v.cast("double")), "isinf": ieee.is_inf, "isfinite": ieee.is_finite, "logical_not": lambda v: v.cast("double") == 0,
}


def _unary(name, f):
    def method(a):
        return a.map(f)

    method.__name__ = name
    return method


def clamp(a, min=None, max=None):  # noqa: A002
    return a.map(lambda v: ieee.clamp(v, min, max))


def _true(v):
    return v.cast("double") != 0


def logical_and(a, b):
    return combine(a, b, lambda x, y: _true(x) & _true(y))


def logical_or(a, b):
    return combine(a, b, lambda x, y: _true(x) | _true(y))


def logical_xor(a, b):
    return combine(a, b, lambda x, y: _true(x) != _true(y))


def eq(a, b):
    return combine(a, b, ieee.eq, lambda x, y: ieee.eq(x["re"], y["re"]) & ieee.eq(x["im"], y["im"]))


def ne(a, b):
    return combine(a, b, ieee.ne, lambda x, y: ~(ieee.eq(x["re"], y["re"]) & ieee.eq(x["im"], y["im"])))


def lt(a, b):
    return combine(a, b, ieee.lt)


def le(a, b):
    return combine(a, b, ieee.le)


def gt(a, b):
    return combine(a, b, ieee.gt)


def ge(a, b):
    return combine(a, b, ieee.ge)


bind(clamp, logical_and, logical_or, logical_xor, pow, *[_unary(k, f) for k, f in UNARY.items()])
for _name, _f in {"add": add, "radd": add, "sub": sub, "rsub": rsub, "mul": mul, "rmul": mul, "truediv": truediv, "rtruediv": rtruediv, "floordiv": floordiv, "pow": pow, "neg": neg, "pos": pos, "abs": Matrix.abs, "eq": eq, "ne": ne, "lt": lt, "le": le, "gt": gt, "ge": ge}.items():
    setattr(Matrix, f"__{_name}__", _f)
Matrix.__hash__ = object.__hash__
