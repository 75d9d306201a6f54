"""Numeric magnitude and its band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number

# Lowest magnitude of each band and the band's label.
BANDS = (
    (0.0, "[0-2)"),
    (2.0, "[2-4)"),
    (4.0, "[4-6)"),
    (6.0, "6+"),
)
UNKNOWN_BAND = "unknown"


def magnitude(mag: Column) -> Column:
    """``mag`` as a double; null where it is no number, NaN included."""
    return number(mag)


def magnitude_band(mag_d: Column) -> Column:
    """Label of the band that holds ``mag_d``; "unknown" for null, NaN or < 0."""
    # Spark orders NaN above every number, so it has to go first.
    band = F.when(F.isnan(mag_d), UNKNOWN_BAND)
    for lowest, label in reversed(BANDS):
        band = band.when(mag_d >= lowest, label)
    return band.otherwise(UNKNOWN_BAND)
