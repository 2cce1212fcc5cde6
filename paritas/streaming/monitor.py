"""Windowed selection rates of two groups over a stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.scalars import four_fifths, ratio


def windowed_impact(events: DataFrame, time: str, group: Column, selected: Column, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Per window: sizes, selection rates, their ratio and the four-fifths flag. For streams and tables alike.

    State is one row of four sums per window; windows older than the watermark are dropped from it.
    """
    rows = events.select(F.col(time).cast("timestamp").alias("t_"), group.alias("g_"), selected.cast("double").alias("s_"))
    rows = rows.withWatermark("t_", late) if events.isStreaming else rows
    got = rows.groupBy(F.window("t_", width, slide or width).alias("w")).agg(
        F.sum(F.when(F.col("g_") == 0, 1).otherwise(0)).alias("n_group0"), F.sum(F.when(F.col("g_") == 1, 1).otherwise(0)).alias("n_group1"),
        F.avg(F.when(F.col("g_") == 0, F.col("s_"))).alias("selection_rate_group0"), F.avg(F.when(F.col("g_") == 1, F.col("s_"))).alias("selection_rate_group1"),
    )
    di = ratio(F.col("selection_rate_group0"), F.col("selection_rate_group1"))
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_group0", "n_group1", "selection_rate_group0", "selection_rate_group1", di.alias("disparate_impact"), four_fifths(di).alias("passes"))
