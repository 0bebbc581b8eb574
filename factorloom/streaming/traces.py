"""Running statistics of trace logs as they grow: an append-only JSON folder as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources.readers import TRACE


def trace_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Steps of a folder that trace files are added to, with event time `at`."""
    steps = spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return steps.withColumn("at", F.to_timestamp("timestamp"))


def windowed_stats(steps: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Steps, failures, tokens and latency by tool and window; rows later than `late` are dropped with their state."""
    called = steps.filter(F.coalesce("tool_called", F.lit("")) != "")
    by = called.withWatermark("at", late).groupBy(F.window("at", width), "tool_called")
    return by.agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col("tool_ok"), 1)).alias("failed"), F.sum("context_tokens").alias("tokens"), F.avg("tool_latency_ms").alias("mean_latency_ms"))


def write_stats(stats: DataFrame, path: str, checkpoint: str):
    """Finished windows, appended as Parquet; the checkpoint makes a restart go on where it stopped."""
    flat = stats.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in stats.columns if c != "window"])
    return flat.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
