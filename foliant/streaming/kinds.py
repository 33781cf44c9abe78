"""The line operators on streams: an extension, as the reference has no streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.lines import kinds


def kinds_stream(docs: DataFrame) -> DataFrame:
    """Line kinds of a stream of documents; stateless, so append mode."""
    return kinds(docs)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value by type in tumbling windows; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
