"""Event tallies by window, the same for batch and stream; late events are kept until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tallies(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total of a batch or streaming DataFrame with ts, event_type and value."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def write_tallies(events: DataFrame, folder: str, checkpoint: str):
    """Starts the stream over what is there and appends closed windows as Parquet; it can be stopped and started again."""
    return tallies(events).writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
