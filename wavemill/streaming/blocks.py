"""The batch operators that also run on streams: blocks of samples as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_stream(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Count, RMS and span of ``value`` per ``user_id`` and tumbling window of ``ts``, for batch or stream.

    On a stream a window comes out once the watermark has passed it; rows later than ``late`` are left out.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    x = F.col("value")
    g = timed.groupBy("user_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.count(x).alias("n"), F.sqrt(F.avg(x * x)).alias("rms"), (F.max(x) - F.min(x)).alias("ptp")
    )
    return g.select("user_id", F.col("w.start").alias("start"), "n", "rms", "ptp")
