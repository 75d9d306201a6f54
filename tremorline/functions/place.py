"""Where an event happened: region text, or a coarse coordinate cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number

# Fixed value: the region of a place that names none.
UNKNOWN_REGION = "Unknown"

MAX_LATITUDE = 90
MAX_LONGITUDE = 180


def region_of(place: Column) -> Column:
    """Text after the last comma of ``place``, without outer spaces.

    ``substring_index`` scans the string once and builds no array. It returns
    the whole text where there is no comma, hence the test.
    """
    tail = F.when(place.contains(","), F.trim(F.substring_index(place, ",", -1)))
    return F.coalesce(F.nullif(tail, F.lit("")), F.lit(UNKNOWN_REGION))


def grid_cell(degrees: Column, size: float, limit: float) -> Column:
    """South or west edge of the ``size``-degree cell that holds ``degrees``.

    Null for text that is no number, for NaN and for values beyond ``limit``.
    """
    value = number(degrees)
    return F.when(
        value.between(-float(limit), float(limit)),
        F.floor(value / F.lit(float(size))) * F.lit(float(size)),
    )


def latitude_cell(latitude: Column, size: float = 5.0) -> Column:
    return grid_cell(latitude, size, MAX_LATITUDE)


def longitude_cell(longitude: Column, size: float = 5.0) -> Column:
    return grid_cell(longitude, size, MAX_LONGITUDE)
