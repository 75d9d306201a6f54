"""Feed rows made from the ``events`` table, for checks and benchmarks.

The table has no feed columns, so they are derived from its ids, times and
values. Every kind of text the parsers handle occurs: both time forms,
unreadable and missing times, magnitudes and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feed import feed_columns


def read_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """``events`` with ``event_ts``: watermarks need a timestamp with a zone."""
    events = spark.read.parquet(f"{data_dir.rstrip('/')}/events.parquet")
    return events.withColumn("event_ts", F.col("ts").cast("timestamp"))


def feed_from_events(spark: SparkSession, data_dir: str) -> DataFrame:
    events = read_events(spark, data_dir)
    number = F.col("event_id")
    instant = F.col("event_ts")
    kind = F.col("event_type")
    user = F.col("user_id")

    time = (
        F.when(number % 97 == 0, "not-a-time")
        .when(number % 89 == 0, F.lit(None))
        .when(number % 4 == 0, F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(number % 4 == 1, F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.unix_millis(instant).cast("string"))
    )
    tenths = F.floor(F.col("value")).cast("int") % 75
    mag = (
        F.when(number % 19 == 0, "")
        .when(number % 23 == 0, "n/a")
        .when(number % 101 == 0, "NaN")
        .otherwise((tenths / 10 - F.lit(0.5)).cast("string"))
    )
    place = (
        F.when(number % 17 == 0, F.lit(None))
        .when(number % 11 == 0, F.concat(F.lit("South of "), kind))
        .when(number % 13 == 0, F.concat(kind, F.lit(", ")))
        .otherwise(
            F.concat(F.lit("5 km NW of "), kind, F.lit(", sub, R"), (user % 7).cast("string"))
        )
    )
    return feed_columns(
        events.select(
            number.cast("string").alias("id"),
            time.alias("time"),
            ((user * 37) % 180 - 90).cast("string").alias("latitude"),
            ((user * 73) % 360 - 180).cast("string").alias("longitude"),
            F.lit("10").alias("depth"),
            mag.alias("mag"),
            F.lit("ml").alias("magType"),
            place.alias("place"),
            F.lit("earthquake").alias("type"),
        )
    )
