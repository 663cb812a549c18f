"""The panel's observations as a stream: tumbling hours with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_hours(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(station, ts, n, total) an hour of a stream of events; rows later than ``late`` after the newest go."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", "1 hour").alias("w"), F.col("event_type").alias("station")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select("station", F.col("w.start").alias("ts"), "n", "total")


def append_to(events: DataFrame, path: str, checkpoint: str):
    """Start the stream into Parquet; closed hours are appended once."""
    return tumbling_hours(events).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).start(path)
