"""Event time from text that holds epoch milliseconds or an ISO-8601 time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number. Zeros before and after it may be any number; the
# digits between and the exponent are bounded, because the decimal cast expands
# the exponent: "1e-99999999" would keep a task busy for minutes.
NUMBER_TEXT = r"^[+-]?0*[0-9]{1,38}([.][0-9]+)?([eE][+-]?0*[0-9]{1,3})?$"

# Milliseconds whose microseconds still fit a bigint.
_MOST_MILLIS = (1 << 63) // 1000


def event_time(time: Column) -> Column:
    """Timestamp for ``time``; null where the text is neither form.

    ISO text without an offset is in the session's zone, which ``open_session``
    sets to UTC. Fractions of a millisecond are cut off.

    Nothing in here throws, with ANSI mode on or off: numbers beyond
    decimal(38,3) become null in the cast, and those whose microseconds would
    not fit a timestamp are null before they are turned into one.
    """
    text = F.trim(time)
    # Cut, not rounded: digits after the third decimal go before the cast, unless an
    # exponent still moves the point; then a wider scale is cut to whole milliseconds.
    cut = F.regexp_replace(text, r"^([^.eE]*[.][0-9]{3})[0-9]+$", "$1")
    plain = F.when(F.contains(text, F.lit(".")), cut).otherwise(text)
    exact = F.when(F.lower(text).contains("e"), _whole(text.try_cast("decimal(38,18)")))
    exact = F.coalesce(exact, _whole(plain.try_cast("decimal(38,3)")))
    fits = F.abs(exact) < F.lit(_MOST_MILLIS)
    millis = F.when(fits, exact).cast("bigint")
    return F.when(_starts_like_a_date(text), text.try_cast("timestamp")).when(
        text.rlike(NUMBER_TEXT), F.timestamp_millis(millis)
    )


def _whole(number: Column) -> Column:
    """Without its fraction, towards zero."""
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))


def _starts_like_a_date(text: Column) -> Column:
    """Dashes where a date has them; much cheaper than a pattern.

    Needed because Spark also reads a bare "12:30" as a timestamp, of today. No
    number has dashes in both places.
    """
    return (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
