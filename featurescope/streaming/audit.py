"""Windowed class audits of a stream (an extra: batch diagnosis is the library's subject).

Counts per event-time window and label, with a watermark for late rows; complete
windows are appended.  State grows with open windows times labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(stream: DataFrame, *, time: str, label: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, label, n of every complete window."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "label", "n")
