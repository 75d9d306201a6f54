"""Small helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def steps_for(array: Column) -> Column:
    """Powers of two up to the array's size, the largest first, for ``count_below``."""
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.filter(powers, lambda p: p <= F.size(array))


def count_below(array: Column, steps: Column, bound: Column) -> Column:
    """Number of elements of a sorted array that are less than ``bound``, by halving."""
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(array, at + step - 1) < bound, at + step).otherwise(at),
    )


def sums_before(values: Column, block: int = 128) -> Column:
    """For each element of an integer array the sum of those before it."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block)),
        lambda b: total(F.slice(values, (b * block + 1).cast("int"), block)),
    )
    return let(
        blocks,
        lambda sums: F.transform(
            values,
            lambda x, i: total(F.slice(sums, 1, F.floor(i / block).cast("int")))
            + total(F.slice(values, (i - i % block + 1).cast("int"), i % block)),
        ),
    )
