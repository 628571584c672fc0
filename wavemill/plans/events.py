"""Queries on the event table, whose operator also runs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.plans.registry import Registry, Tables
from wavemill.streaming.blocks import block_stream

REG = Registry()


@REG.add(
    "select user_id, strftime(time_bucket(interval 60 minutes, ts), '%Y-%m-%d %H:%M') as start, count(value) as n, round(sqrt(avg(value * value)), 6) as rms, round(max(value) - min(value), 6) as ptp from events group by all"
)
def event_blocks(t: Tables) -> DataFrame:
    """Hourly blocks of each user's values (WIN1 on the clock, AGG1)."""
    b = block_stream(t.events)
    return b.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("rms", 6).alias("rms"), F.round("ptp", 6).alias("ptp"))
