"""Products of large matrices by blocks of rows: each task has the rows of one block and the entries of the other factor that they meet.

Terms are added up where they arise, so nothing but the factors and the result
crosses the network; entries of the other factor go to each block that meets
them. Blocks have about the same number of terms, counted beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..kernels.products import multiply, multiply_at
from ..matrix import Matrix
from ..sizes import read_bytes

#: Tables of fewer bytes are joined instead: one plan, no job beforehand.
LARGE = 16 << 20
#: Terms of a block, and ranges of rows whose terms are counted (a row each on the driver).
TERMS, RANGES = 1 << 23, 4096


def fit(*factors: Matrix) -> bool:
    """Whether a product is one for blocks: of single matrices of doubles, from large tables."""
    return all(not m.keys and m.dtype == "double" for m in factors) and max(read_bytes(m.df) for m in factors) >= LARGE


def settled(a: Matrix) -> Matrix:
    """``a`` with one entry a place, written once if it is more than a table to be read."""
    a = a.coalesce()
    plan = a.df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    if not plan.nodeName().startswith("LogicalRelation") and not plan.nodeName().startswith("Relation"):
        a.df = cut(a.df)
    return a


def _entries(df: DataFrame, tag: int, block: str = "_b") -> DataFrame:
    return df.select(F.col(block).cast("int").alias("_b"), F.lit(tag).cast("tinyint").alias("_t"), F.col("_p"), F.col("_q"), F.col("_v"))


def _range(row, size: int):
    return F.least(F.greatest(F.floor(row / size), F.lit(-1)), F.lit(RANGES)).cast("int")


def _blocks(df: DataFrame, key: str, other: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``df`` (_p, ...) with its block ``_b``, and the number of blocks; the terms of a row of ``df`` are the rows of ``other`` with its ``key``."""
    size = max(1, -(-rows // RANGES))
    many = other.groupBy(key).agg(F.count("*").alias("_n"))
    work = df.join(many, key, "left").groupBy(_range(F.col("_p"), size).alias("_r")).agg(F.sum(F.coalesce("_n", F.lit(0)) + 1).alias("w")).orderBy("_r").collect()
    found, block, have = [], 0, 0
    for r in work:
        if r["w"] > TERMS and size > 1:  # a range of too many terms: its rows in turn
            block += have > 0
            split = min(size, -(-r["w"] // TERMS))
            found.append((r["_r"], block, split))
            block, have = block + split, 0
            continue
        if have and have + r["w"] > TERMS:
            block, have = block + 1, 0
        found.append((r["_r"], block, 1))
        have += r["w"]
    n = block + (have > 0)
    spark = df.sparkSession
    to = F.broadcast(spark.createDataFrame(found, "_r int, _first int, _split int"))  # a row for each range
    placed = df.withColumn("_r", _range(F.col("_p"), size)).join(to, "_r")
    return placed.withColumn("_b", (F.col("_first") + F.pmod(F.col("_p"), F.col("_split"))).cast("int")).drop("_r", "_first", "_split"), max(1, n)


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    v = table.column("_v")
    known = np.asarray(v.is_valid())
    return np.asarray(table.column("_p")), np.asarray(table.column("_q")), np.asarray(v.fill_null(0.0)), known


def _run(kernel):
    """Batches of one task's blocks to batches of results; a task seldom has more than one block."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        all_ = pa.Table.from_batches(batches)
        del batches
        blocks = np.asarray(all_.column("_b"))
        for b in np.unique(blocks):
            own = all_.filter(pa.array(blocks == b)) if blocks[0] != blocks[-1] or (blocks != b).any() else all_
            tags = np.asarray(own.column("_t"))
            yield from kernel(lambda tag, own=own, tags=tags: _arrays(own.filter(pa.array(tags == tag))))

    return run


def _batches(columns: dict):
    return pa.table(columns).to_batches(1 << 17)


def _product(part):
    for row, col, val, known in multiply(part(1), part(2)):
        yield from _batches({"row": pa.array(row), "col": pa.array(col), "val": pa.array(val, mask=~known)})


def _product_at(part):
    pr, pc, _, _ = part(0)
    for row, col, val in multiply_at(pr, pc, part(1), part(2)):
        yield from _batches({"row": pa.array(row), "col": pa.array(col), "v": pa.array(val)})


def _no_null(name: str):
    """Rows and columns that a table leaves out stand as -1 in a task."""
    return F.coalesce(name, F.lit(-1).cast("long"))


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.nullif(F.col(k), F.lit(-1).cast("long")) for k in ("row", "col")})


def product(left: Matrix, right: Matrix) -> DataFrame:
    """``row, col, val`` of the product of settled matrices."""
    x = left.df.where("col is not null").select(_no_null("row").alias("_p"), F.col("col").alias("_q"), F.col("val").alias("_v"))
    y = right.df.where("row is not null").select(F.col("row").alias("_q"), _no_null("col").alias("_c"), F.col("val").alias("_v"))
    x, n = _blocks(x, "_q", y, left.m)
    needs = x.select("_b", "_q").distinct()
    y = y.join(needs, "_q").select("_b", F.col("_q").alias("_p"), F.col("_c").alias("_q"), "_v")
    all_ = _entries(x, 1).unionByName(_entries(y, 2)).repartitionById(n, F.col("_b"))
    return _with_nulls(all_.mapInArrow(_run(_product), "row long, col long, val double"))


def product_at(left: Matrix, right: Matrix, places: DataFrame, rows: int) -> DataFrame:
    """``row, col, v`` of the product at ``places`` alone; a place has a term for each entry of ``right`` in its column."""
    p = places.select(_no_null("row").alias("_p"), _no_null("col").alias("_q"), F.lit(None).cast("double").alias("_v"))
    y = right.df.where("row is not null and col is not null").select(F.col("row").alias("_k"), F.col("col").alias("_q"), F.col("val").alias("_v"))
    p, n = _blocks(p, "_q", y, rows)
    needs = p.select("_b", "_q").distinct()
    y = y.join(needs, "_q").select("_b", F.col("_k").alias("_p"), "_q", "_v")
    own = p.select("_b", "_p").distinct()
    x = left.df.where("col is not null").select(F.col("row").alias("_p"), F.col("col").alias("_q"), F.col("val").alias("_v")).join(own, "_p")
    all_ = _entries(p, 0).unionByName(_entries(x, 1)).unionByName(_entries(y, 2)).repartitionById(n, F.col("_b"))
    return _with_nulls(all_.mapInArrow(_run(_product_at), "row long, col long, v double"))
