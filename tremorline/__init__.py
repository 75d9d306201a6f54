"""Counts of seismic events per time window, region and magnitude, on Spark."""

from .schema import FEED_COLUMNS, FEED_SCHEMA, RESULT_SCHEMA
from .session import ROCKSDB_STATE, open_session, use_utc

__all__ = [
    "FEED_COLUMNS",
    "FEED_SCHEMA",
    "RESULT_SCHEMA",
    "ROCKSDB_STATE",
    "open_session",
    "use_utc",
]
