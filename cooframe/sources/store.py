"""Matrices as Parquet with a table of their shape, whole or by part."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sizes
from ..matrix import Matrix


def write(a: Matrix, path: str, metadata: dict | None = None, parts: DataFrame | None = None) -> None:
    """``parts`` (node, part_id) lays entries out by the part of their row; the full shape is kept.

    A part of a large matrix is written by as many tasks as its size asks for, a range of rows each.
    """
    df = a.df
    if parts is not None:
        n = sizes.parts(df)
        df = df.join(parts.select(F.col("node").alias("row"), "part_id"), "row")
        df = df.repartition("part_id") if n is None else df.repartitionByRange(n, "part_id", "row")
        df.write.partitionBy("part_id").parquet(f"{path}/entries")
        parts.write.parquet(f"{path}/parts")
    else:
        df.write.parquet(f"{path}/entries")
    meta = {"m": a.m, "n": a.n, "keys": a.keys, "batch": a.batch, "block": a.block, "coalesced": a.coalesced, "parted": parts is not None, "metadata": metadata or {}}
    if a.sizes is not None:
        a.sizes.write.parquet(f"{path}/sizes")
    a.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def _meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()["value"])


def read_metadata(spark: SparkSession, path: str) -> dict:
    return _meta(spark, path)["metadata"]


def read(spark: SparkSession, path: str, part: int | None = None) -> Matrix:
    """The matrix, or the rows of one part: other parts' files are not read."""
    meta = _meta(spark, path)
    df = spark.read.parquet(f"{path}/entries")
    if meta["parted"]:
        df = (df.where(F.col("part_id") == part) if part is not None else df).drop("part_id")
    shapes = spark.read.parquet(f"{path}/sizes") if "matrix_id" in meta["keys"] else None
    return Matrix(df, meta["m"], meta["n"], meta["keys"], shapes, meta["batch"], meta["block"], meta["coalesced"])


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parts")
