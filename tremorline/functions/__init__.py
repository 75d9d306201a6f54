"""Column expressions. All are built from Spark's own functions."""

from .event_time import event_time
from .magnitude import BANDS, UNKNOWN_BAND, magnitude, magnitude_band
from .place import UNKNOWN_REGION, grid_cell, latitude_cell, longitude_cell, region_of

__all__ = [
    "BANDS",
    "UNKNOWN_BAND",
    "UNKNOWN_REGION",
    "event_time",
    "grid_cell",
    "latitude_cell",
    "longitude_cell",
    "magnitude",
    "magnitude_band",
    "region_of",
]
