"""Counts per group, with or without an event-time window.

All take batch and streaming frames alike. Spark counts map-side before the
shuffle, so a group that holds a third of all rows arrives at the reducer as
one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pandas import Timedelta
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Window length and lateness tolerance of the standard result.
WINDOW = "15 minutes"
DELAY = "30 minutes"

RESULT_KEYS = ("region", "magnitude_band")


def group_counts(events: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Rows per group, over all time."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def window_counts(
    events: DataFrame,
    keys: Sequence[str] = RESULT_KEYS,
    length: str = WINDOW,
    slide: str | None = None,
    delay: str = DELAY,
) -> DataFrame:
    """Rows per event-time window and group; ``slide`` makes windows overlap.

    ``delay`` is how late an event may be before a stream ignores it. A longer
    delay keeps windows open, and in state, for longer; shorten it to free
    state sooner. It has no effect on a batch frame. Rows without an event time
    are in no window.
    """
    return flatten_window(window_totals(events, keys, length, slide, delay))


def window_totals(
    events: DataFrame,
    keys: Sequence[str],
    length: str = WINDOW,
    slide: str | None = None,
    delay: str = DELAY,
) -> DataFrame:
    """``window_counts`` with the window left as one ``window`` column.

    A stream can aggregate this again: the column still carries the watermark.
    """
    if events.isStreaming:
        return (
            events.withWatermark("event_ts", delay)
            .groupBy(F.window("event_ts", length, slide), *keys)
            .agg(F.count(F.lit(1)).alias("count"))
        )
    if slide is not None and _divides(slide, length):
        # Each row is counted once, in a window of the slide's length; only
        # those counts are spread over the windows that overlap there.
        panes = window_totals(events, keys, slide)
        windows = F.window(_not_null("window.start"), length, slide)
        return panes.groupBy(windows, *keys).agg(F.sum("count").alias("count"))
    # The stand-in for a missing time adds nothing to a count.
    return (
        events.groupBy(F.window(_not_null("event_ts"), length, slide), *keys)
        .agg(F.count("event_ts").alias("count"))
        .where(F.col("count") > 0)
    )


def pane_counts(
    events: DataFrame,
    keys: Sequence[str],
    length: str,
    slide: str,
    delay: str = DELAY,
) -> DataFrame:
    """Rows per pane and group: parts as long as ``slide``, of which windows of ``length`` consist.

    In a stream a pane stays in state until the last window that holds it has closed, so it
    takes every event that is in time for one of its windows. For that the time is moved on by the
    time between the two ends, and the watermark as much further back: it is the same as by window.
    """
    after = time_after_pane(length, slide)
    if not events.isStreaming:
        return window_counts(events, keys, slide)
    distance = F.expr(f"interval {after} milliseconds")
    moved = events.withColumn("_moved_ts", F.col("event_ts") + distance)
    panes = (
        moved.withWatermark("_moved_ts", f"{after + _millis(delay)} milliseconds")
        .groupBy(F.window("_moved_ts", slide), *keys)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return flatten_window(panes).withColumns(
        {name: F.col(name) - distance for name in ("window_start", "window_end")}
    )


def time_after_pane(length: str, slide: str) -> int:
    """Milliseconds from the end of a pane to the end of the last window that holds it."""
    if not _divides(slide, length):
        raise ValueError(f"{length} is no multiple of {slide}")
    return _millis(length) - _millis(slide)


def _millis(duration: str) -> int:
    return Timedelta(duration) // Timedelta(milliseconds=1)


def _not_null(time: str) -> Column:
    """``time`` with a stand-in for null.

    Windows of a nullable time come with a filter, which Spark moves down to
    the scan with all that defines the time: the text would be parsed again.
    """
    return F.coalesce(time, F.timestamp_seconds(F.lit(0)))


def _divides(part: str, whole: str) -> bool:
    """Whether one duration is a multiple of another; no if not plainly so."""
    try:
        return Timedelta(whole) % Timedelta(part) == Timedelta(0)
    except ValueError:
        return False


def flatten_window(counted: DataFrame) -> DataFrame:
    """``window`` as two timestamp columns, in front of the others."""
    others = [name for name in counted.columns if name != "window"]
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *others,
    )
