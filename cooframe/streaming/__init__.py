"""Matrices that grow by a stream of entries; beyond the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_entries(stream: DataFrame, row: str, col: str, val: str) -> DataFrame:
    """``row, col, val``: entries of a stream added up so far; for output mode update or complete."""
    return stream.groupBy(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col")).agg(F.sum(val).alias("val"))


def windowed_entries(stream: DataFrame, ts: str, row: str, col: str, val: str, length: str, late: str) -> DataFrame:
    """One matrix for each window of event time; entries later than ``late`` are left out and closed windows leave the state."""
    timed = stream.withWatermark(ts, late)
    by = [F.window(ts, length).alias("window"), F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col")]
    return timed.groupBy(*by).agg(F.sum(val).alias("val")).select(F.col("window.start").alias("start"), "row", "col", "val")


def running_product(x: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the change that a batch of entries makes to A x, given to ``sink`` with the batch's number.

    Products are linear, so a batch's own product is all that is needed; a sink
    that is keyed by the number takes a repeated batch once.
    """

    def batch(entries: DataFrame, number: int) -> None:
        own = entries.groupBy("row", "col").agg(F.sum("val").alias("val"))
        change = own.join(x.select(F.col("i").alias("col"), F.col("v").alias("_x")), "col").groupBy(F.col("row").alias("i")).agg(F.sum(F.col("val") * F.col("_x")).alias("v"))
        sink(change, number)

    return batch
