"""Where feed rows come from, and the CSV files they are kept in."""

from .events_table import feed_from_events, read_events
from .feed import (
    MAX_RECORDS,
    feed_columns,
    read_feed,
    read_raw,
    read_rejects,
    read_whole_rows,
    stream_feed,
    write_microfiles,
)

__all__ = [
    "MAX_RECORDS",
    "feed_columns",
    "feed_from_events",
    "read_events",
    "read_feed",
    "read_raw",
    "read_rejects",
    "read_whole_rows",
    "stream_feed",
    "write_microfiles",
]
