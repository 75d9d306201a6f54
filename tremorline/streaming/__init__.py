"""Streaming job, its outputs and its late-data report."""

from .audit import open_counts, reconcile
from .job import (
    build_stream,
    start,
    start_console,
    start_sliding,
    start_table,
    stream_counts,
    stream_events,
    wait_for_all,
)
from .late import LateEvents, LateRecorder, late_report, read_late
from .sinks import (
    ClosedSlidingWindows,
    ClosedWindows,
    append_table,
    callback,
    compact,
    console,
    each_batch,
    read_changelog,
    read_final,
    top_table,
    versioned_table,
    write_parquet,
)

__all__ = [
    "ClosedSlidingWindows",
    "ClosedWindows",
    "LateEvents",
    "LateRecorder",
    "append_table",
    "build_stream",
    "callback",
    "compact",
    "console",
    "each_batch",
    "late_report",
    "open_counts",
    "read_changelog",
    "read_final",
    "read_late",
    "reconcile",
    "start",
    "start_console",
    "start_sliding",
    "start_table",
    "stream_counts",
    "stream_events",
    "top_table",
    "versioned_table",
    "wait_for_all",
    "write_parquet",
]
