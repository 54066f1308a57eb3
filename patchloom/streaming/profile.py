"""The case profile over a stream of records that repeat and arrive late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_records(stream: DataFrame, key: str, at: str = "ingested_at", late: str = "30 days") -> DataFrame:
    """Each key once within the time that rows may be late; state older than that is dropped. Rows without a key or a time are left out."""
    some = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return some.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def profile(stream: DataFrame, late: str = "30 days", every: str = "1 day") -> DataFrame:
    """window, n, mean_changed, detection_rate of the cases by the day of their arrival; a window is final when the watermark has passed it."""
    once = first_records(stream, "case_id", late=late)
    found = F.avg((F.col("qchecker_findings") > 0).cast("double"))
    counted = once.groupBy(F.window("ingested_at", every).alias("window")).agg(F.count("*").alias("n"), F.round(F.avg("total_lines_changed"), 4).alias("mean_changed"), F.round(found, 4).alias("detection_rate"))
    return counted.select(F.col("window.start").alias("day"), "n", "mean_changed", "detection_rate")
