"""Steps that add columns to feed rows and keep the given ones."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    event_time,
    latitude_cell,
    longitude_cell,
    magnitude,
    magnitude_band,
    region_of,
)


def with_event_time(feed: DataFrame) -> DataFrame:
    return feed.withColumn("event_ts", event_time(F.col("time")))


def with_region_and_magnitude(feed: DataFrame) -> DataFrame:
    # The band refers to the column, so the text is read once for both.
    return feed.withColumns(
        {"region": region_of(F.col("place")), "mag_d": magnitude(F.col("mag"))}
    ).withColumn("magnitude_band", magnitude_band(F.col("mag_d")))


def with_grid(feed: DataFrame, size: float = 5.0) -> DataFrame:
    return feed.withColumns(
        {
            "lat_cell": latitude_cell(F.col("latitude"), size),
            "lon_cell": longitude_cell(F.col("longitude"), size),
        }
    )


def enrich(feed: DataFrame) -> DataFrame:
    """Feed rows with ``event_ts``, ``region``, ``mag_d`` and ``magnitude_band``."""
    return feed.transform(with_event_time).transform(with_region_and_magnitude)


def keep_recent(feed: DataFrame, days: float, now: datetime | None = None) -> DataFrame:
    """Rows whose event time lies within ``days`` before ``now``; 0 keeps all.

    The test is on the parsed time, so both text forms count. Rows without a
    readable time are dropped when the filter is on. ``now`` without a zone is
    taken as UTC; give it where results have to be repeatable.
    """
    if days < 0:
        raise ValueError("days must not be negative")
    if not days:
        return feed
    now = now or datetime.now(timezone.utc)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    return feed.where(event_time(F.col("time")) >= F.lit(now - timedelta(days=days)))
