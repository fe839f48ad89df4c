"""Scalar functions with IEEE results under ANSI SQL: no error, no null, floats stay floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def div(a, b) -> Column:
    """a / b: infinite or NaN where b is zero."""
    a, b = _d(a), _d(b)
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) == (F.lit(1.0) * F.signum(_inverse_sign(b)) > 0), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def _inverse_sign(b: Column) -> Column:
    """1 for +0.0 and -1 for -0.0."""
    return F.when(b.cast("string") == "-0.0", F.lit(-1.0)).otherwise(F.lit(1.0))


def _log(f, x) -> Column:
    x = _d(x)
    return F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(f(x))


def ln(x) -> Column:
    return _log(F.ln, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def is_inf(x) -> Column:
    return F.abs(_d(x)) == INF


def is_finite(x) -> Column:
    return ~F.isnan(_d(x)) & ~is_inf(x)


def _whole(f, x) -> Column:
    """Beyond 2^53 every double is whole already."""
    x = _d(x)
    return F.when(F.isnan(x) | (F.abs(x) >= float(1 << 53)), x).otherwise(f(x).cast("double"))


def floor(x) -> Column:
    return _whole(F.floor, x)


def ceil(x) -> Column:
    return _whole(F.ceil, x)


def round_even(x) -> Column:
    return F.rint(_d(x))


def floordiv(a, b) -> Column:
    return floor(div(a, b))


def sqrt(x) -> Column:
    return F.sqrt(_d(x))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_d(x)))


def relu(x) -> Column:
    return F.when(_d(x) < 0, F.lit(0.0)).otherwise(_d(x))


def clamp(x, low=None, high=None) -> Column:
    """Bounds, either of them optional; NaN stays."""
    x = out = _d(x)
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(F.isnan(x), x).otherwise(out)


def sign(x) -> Column:
    return F.signum(_d(x))


def eq(a, b) -> Column:
    return ~F.isnan(_d(a)) & ~F.isnan(_d(b)) & (_d(a) == _d(b))


def ne(a, b) -> Column:
    return ~eq(a, b)


def _ordered(op, a, b) -> Column:
    a, b = _d(a), _d(b)
    return ~F.isnan(a) & ~F.isnan(b) & op(a, b)


def lt(a, b) -> Column:
    return _ordered(lambda x, y: x < y, a, b)


def le(a, b) -> Column:
    return _ordered(lambda x, y: x <= y, a, b)


def gt(a, b) -> Column:
    return _ordered(lambda x, y: x > y, a, b)


def ge(a, b) -> Column:
    return _ordered(lambda x, y: x >= y, a, b)


def greatest_of(v) -> Column:
    """Aggregate maximum in which NaN wins (Spark's own order puts NaN last, so it does)."""
    return F.max(v)


def least_of(v) -> Column:
    """Aggregate minimum in which NaN wins."""
    return F.when(F.bool_or(F.isnan(v)), F.lit(NAN)).otherwise(F.min(v))
