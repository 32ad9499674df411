"""The daily national series over a stream of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Events and their value by day and type, with late rows up to a bound; works on a batch table alike."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").cast("date").alias("date"), "event_type", "n", "value")
