"""Windowed utilisation from telemetry streams (the same code serves batch tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(samples: DataFrame, stamp: str, device: str, value: str, window: str = "10 minutes",
             lateness: str | None = None) -> DataFrame:
    """Average, maximum and sample count per device and tumbling window.

    With ``lateness`` the stream's state is bounded by a watermark and windows are final once it
    has passed them.
    """
    if lateness:
        samples = samples.withWatermark(stamp, lateness)
    return samples.groupBy(F.window(stamp, window).alias("w"), F.col(device)).agg(
        F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.count(F.lit(1)).alias("samples")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), device, "avg_value", "max_value",
        "samples")


def append_windows(stream: DataFrame, path: str, checkpoint: str) -> None:
    (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start(path).awaitTermination())
