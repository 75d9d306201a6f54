"""Numbers from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """``text`` as a double; null where it is none. NaN counts as none.

    A failing cast raises and catches an exception per row inside Spark, which
    costs more than reading the row. So text that starts beyond the digits in
    ASCII order, as "n/a" does, is not tried; of such text only the names of
    infinity are numbers.
    """
    trimmed = F.trim(text)
    may_be_number = ((trimmed != "") & (trimmed < ":")) | F.lower(trimmed).isin("inf", "infinity")
    return F.nanvl(F.when(may_be_number, trimmed.try_cast("double")), F.lit(None).cast("double"))
