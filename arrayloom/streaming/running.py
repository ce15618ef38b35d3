"""Running statistics over a stream: the same accumulators as operators.stats.running, by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.operators import stats


def windowed(events: DataFrame, time: str, value: str, by: list[str], size: str, late: str, step: str | None = None) -> DataFrame:
    """Accumulators and summaries of each window and `by` group; what comes later than `late` is dropped.

    Works on a stream and on a batch alike; on a stream, write it in append mode to get each window once.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if events.isStreaming else timed
    window = F.window(time, size, step) if step else F.window(time, size)
    cols = timed.withColumn("_w", window)
    out = stats.running(cols, value, by=["_w", *by])
    return stats.summary(out).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "total", "squares", "max", "min", "n", "mean", "std")


def run_once(spark: SparkSession, source: str, schema, transform, name: str) -> DataFrame:
    """Run a query over all of a folder's Parquet files as a stream, and return what it made, from memory. For tests."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.table(name)
