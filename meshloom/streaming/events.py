"""An extension without a counterpart to match: demand events counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """A stream of the event files that come to a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, event_type, n, total)`` by tumbling windows, batch or stream; state of windows older than ``late`` is let go."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run(counts: DataFrame, path: str, checkpoints: str):
    """Write closed windows to ``path`` until all that is there is read."""
    return counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoints).outputMode("append").trigger(availableNow=True).start()
