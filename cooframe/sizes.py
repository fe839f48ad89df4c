"""How much a frame reads, and exchanges of as many parts as that asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of tables that a part of an exchange stands for, and below which Spark chooses the parts itself.
SHARE, SMALL = 8 << 20, 16 << 20


def read_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads; rows that came from the driver count for nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 62)


def parts(df: DataFrame) -> int | None:
    """Parts of an exchange of a large ``df``, so that a task's share does not grow with it; None for a small one."""
    size = read_bytes(df)
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE)) if size >= SMALL else None


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A large ``df`` exchanged by ``by`` before it is grouped by these.

    Where most groups are of one row, adding up before the exchange only fills
    the memory of tasks that read large files.
    """
    n = parts(df)
    return df if n is None else df.repartition(n, *by)
