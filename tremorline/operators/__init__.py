"""DataFrame to DataFrame steps, for batch and streaming frames."""

from .counts import (
    DELAY,
    RESULT_KEYS,
    WINDOW,
    flatten_window,
    group_counts,
    pane_counts,
    time_after_pane,
    window_counts,
    window_totals,
)
from .enrich import enrich, keep_recent, with_event_time, with_grid, with_region_and_magnitude
from .topn import top_groups, top_groups_chained

__all__ = [
    "DELAY",
    "RESULT_KEYS",
    "WINDOW",
    "enrich",
    "flatten_window",
    "group_counts",
    "keep_recent",
    "pane_counts",
    "time_after_pane",
    "top_groups",
    "top_groups_chained",
    "window_counts",
    "window_totals",
    "with_event_time",
    "with_grid",
    "with_region_and_magnitude",
]
