from pyspark.sql import functions as F

from cooframe.operators.krylov import to_frame
from cooframe.streaming import running_entries, running_product, windowed_entries


def stream(spark, tmp_path):
    """Two files of entries, one a batch."""
    schema = "ts timestamp, r long, c long, v double"
    for k, rows in enumerate(([("2024-01-01 00:00:01", 0, 0, 1.0), ("2024-01-01 00:00:02", 0, 1, 2.0)], [("2024-01-01 00:00:03", 0, 0, 4.0), ("2024-01-01 00:01:30", 1, 1, 8.0)])):
        spark.createDataFrame(rows, "ts string, r long, c long, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    return spark.readStream.schema(schema + ", k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_entries_add_up(spark, tmp_path):
    q = running_entries(stream(spark, tmp_path), "r", "c", "v").writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.row, r.col, r.val) for r in spark.table("running").collect()} == {(0, 0, 5.0), (0, 1, 2.0), (1, 1, 8.0)}


def test_windows_close(spark, tmp_path):
    q = windowed_entries(stream(spark, tmp_path), "ts", "r", "c", "v", "1 minute", "10 seconds").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start.minute, r.row, r.col, r.val) for r in spark.table("windows").collect()}
    assert got == {(0, 0, 0, 5.0), (0, 0, 1, 2.0)}


def test_products_of_batches_add_up_to_the_product(spark, tmp_path):
    seen = {}
    entries = stream(spark, tmp_path).select(F.col("r").alias("row"), F.col("c").alias("col"), F.col("v").alias("val"))
    sink = lambda change, number: seen.__setitem__(number, {r.i: r.v for r in change.collect()})
    q = entries.writeStream.foreachBatch(running_product(to_frame(spark, [10.0, 1.0]), sink)).trigger(availableNow=True).start()
    q.awaitTermination()
    total = {}
    for change in seen.values():
        for i, v in change.items():
            total[i] = total.get(i, 0) + v
    assert total == {0: 52.0, 1: 8.0} and len(seen) == 2
