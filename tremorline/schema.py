"""Row layouts shared by the batch jobs and the streams."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

# The feed's column names, in file order. CSV files are read by
# position, so this order is part of the file format.
FEED_COLUMNS = (
    "id",
    "time",
    "latitude",
    "longitude",
    "depth",
    "mag",
    "magType",
    "place",
    "type",
)

FEED_SCHEMA = StructType([StructField(name, StringType(), True) for name in FEED_COLUMNS])

RESULT_SCHEMA = StructType(
    [
        StructField("window_start", TimestampType(), True),
        StructField("window_end", TimestampType(), True),
        StructField("region", StringType(), True),
        StructField("magnitude_band", StringType(), True),
        StructField("count", LongType(), True),
    ]
)
