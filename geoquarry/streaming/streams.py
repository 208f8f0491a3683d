"""Streams beside tracking: latest frame, live logs, windows over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_frame(frames: DataFrame, source: str, order: str, payload: list[str]) -> DataFrame:
    """The newest frame of each source; as a streaming aggregate its state is one row a source."""
    return frames.groupBy(source).agg(F.max_by(F.struct(order, *payload), order).alias("_f")).select(source, "_f.*")


def strided(frames: DataFrame, number: str, stride: int) -> DataFrame:
    """Every ``stride``-th frame of a video, as a player would read it."""
    return frames.where(F.col(number) % stride == 0)


def last_log(log: DataFrame, run: str, step: str, values: list[str]) -> DataFrame:
    """The row of the greatest step of each run."""
    return log.groupBy(run).agg(F.max_by(F.struct(step, *values), step).alias("_l")).select(run, "_l.*")


def event_time(column: str) -> Column:
    """Event times without zone as instants in the session's zone, which watermarks need."""
    return F.col(column).cast("timestamp")


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, value: str, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling windows; ``late`` sets a watermark for streams."""
    rows = events.withColumn("_t", event_time(ts))
    rows = rows.withWatermark("_t", late) if late else rows
    out = rows.groupBy(*keys, F.window("_t", width).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("_w.start").alias("start"), "n", "total")


def sliding(events: DataFrame, ts: str, keys: list[str], width: str, step: str, late: str | None = None) -> DataFrame:
    """Counts in windows that overlap: ``width`` wide, one every ``step``."""
    rows = events.withColumn("_t", event_time(ts))
    rows = rows.withWatermark("_t", late) if late else rows
    return rows.groupBy(*keys, F.window("_t", width, step).alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: ends, events."""
    rows = events.withColumn("_t", event_time(ts))
    rows = rows.withWatermark("_t", late) if late else rows
    out = rows.groupBy(key, F.session_window("_t", gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("_w.start").alias("start"), "n")


def first_of(events: DataFrame, ts: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Distinct keys; on a stream within the watermark."""
    if late is None:
        return events.dropDuplicates(keys)
    return events.withColumn("_t", event_time(ts)).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys)


def running_mean(rows: DataFrame, run: str, value: str) -> DataFrame:
    """Mean so far of each run, as a streaming aggregate."""
    return rows.groupBy(run).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
