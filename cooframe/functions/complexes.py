"""Complex values as struct<re: double, im: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<re:double,im:double>"


def of(re, im=0.0) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(as_column(re).cast("double").alias("re"), as_column(im).cast("double").alias("im"))


def literal(z: complex) -> Column:
    return of(z.real, z.imag)


def conj(z: Column) -> Column:
    return of(z["re"], -z["im"])


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def add(a: Column, b: Column) -> Column:
    return of(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return of(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def neg(a: Column) -> Column:
    return of(-a["re"], -a["im"])


def total(z: Column) -> Column:
    """Aggregate sum."""
    return of(F.sum(z["re"]), F.sum(z["im"]))


ZERO = (0.0, 0.0)
