"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new place under spark.checkpoint.dir; where that is unset and the master local, under a folder that goes when Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="cooframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_paths: dict[int, tuple[DataFrame, str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again."""
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table of a frame that ``cut`` gave, once nothing reads it any more; other frames are left alone."""
    found = _paths.pop(id(df), None)
    if found is not None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(found[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
