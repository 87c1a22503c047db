"""Structured Streaming: debouncing, windows, marks by user, and where a run stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """STM-06: the last event of each burst: a session ends after `gap` without events. For a stream give
    `late`, how long to wait for late events."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(key, F.session_window(ts, gap).alias("burst")).agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last")).select(key, "events", "last")


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """STM-11: counts by event-time window, late events within `late` included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).count().select(F.col("w.start").alias("start"), *keys, "count")


def bookmarks(toggles: DataFrame, user: str, path: str) -> DataFrame:
    """STM-09: what is marked: toggled an odd number of times."""
    return toggles.groupBy(user, path).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 2 == 1).select(user, path)


def breaker(results: DataFrame, order: str, throttles: int = 20, failures: int = 100) -> DataFrame:
    """STM-04: `results` (run, status) up to the row where a run stops: after so many throttles in a row,
    or so many failures in all."""
    w = Window.partitionBy("run").orderBy(order)
    rows = results.withColumn("_break", F.sum(F.when(F.col("status") != "throttle", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_row", F.sum(F.when(F.col("status") == "throttle", 1).otherwise(0)).over(Window.partitionBy("run", "_break").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_fail", F.sum(F.when(F.col("status") == "fail", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = (F.col("_row") >= throttles) | (F.col("_fail") >= failures)
    before = F.max(F.when(stop, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_stopped", F.coalesce(before, F.lit(0)))
    return rows.where("_stopped = 0").drop("_break", "_row", "_fail", "_stopped")
