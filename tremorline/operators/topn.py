"""The regions with most events in each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counts import DELAY, WINDOW, flatten_window, window_totals


def top_groups(counts: DataFrame, n: int, key: str = "region") -> DataFrame:
    """The ``n`` largest ``key`` groups of each window, for a batch frame.

    ``counts`` has ``window_start``, ``window_end``, ``key`` and ``count``;
    further key columns are summed over. Equal counts rank by name. Spark
    turns the row-number filter into a limit per window before the shuffle, so
    a task sends at most ``n`` rows of a window however many groups it has.

    In a stream, apply it per micro-batch and to append output only: there a
    window arrives whole, while update output holds just the changed groups.
    """
    _check(n)
    grouping = ["window_start", "window_end", key]
    totals = counts
    if set(counts.columns) != {*grouping, "count"}:
        totals = counts.groupBy(*grouping).agg(F.sum("count").alias("count"))
    largest_first = Window.partitionBy("window_start").orderBy(F.desc("count"), F.asc(key))
    return (
        totals.withColumn("rank", F.row_number().over(largest_first))
        .where(F.col("rank") <= n)
        .select("window_start", "window_end", "rank", key, "count")
    )


def top_groups_chained(
    events: DataFrame,
    n: int,
    key: str = "region",
    length: str = WINDOW,
    slide: str | None = None,
    delay: str = DELAY,
    buckets: int = 1024,
    levels: int = 1,
) -> DataFrame:
    """Same result as plain aggregations, which a stream can run in append mode.

    Spark has no bounded top-n aggregate, so the groups of a window are first
    spread by hash over ``buckets ** levels`` lists, each list keeps its ``n`` best, ``buckets`` lists
    become one, and so on up to the window. A list of the first level holds one entry per group of
    its bucket, any other at most ``n * buckets`` entries, never all groups of a window.

    One level is for keys with a moderate number of values. Where keys are free text take as many
    that ``buckets ** levels`` exceeds the groups of a window; each level is one more shuffle
    and state operator. Or use ``top_groups`` in the batch callback (``top_table``), which keeps no lists.
    """
    _check(n)
    if levels < 1 or buckets < 1:
        raise ValueError("levels and buckets must be at least 1")
    totals = window_totals(events, (key,), length, slide, delay)
    entry = F.struct((-F.col("count")).alias("negated"), F.col(key).alias("name"))
    place = F.pmod(F.xxhash64(key), F.lit(buckets**levels)).alias("bucket")
    best = totals.groupBy("window", place).agg(_first_entries(F.collect_list(entry), n).alias("best"))
    merged = _first_entries(F.flatten(F.collect_list("best")), n).alias("best")
    for level in range(levels - 1, 0, -1):
        place = (F.col("bucket") % F.lit(buckets**level)).alias("bucket")
        best = best.groupBy("window", place).agg(merged)
    per_window = best.groupBy("window").agg(merged)
    ranked = per_window.select("window", F.posexplode("best").alias("position", "entry"))
    return flatten_window(
        ranked.select(
            "window",
            (F.col("position") + 1).alias("rank"),
            F.col("entry.name").alias(key),
            (-F.col("entry.negated")).alias("count"),
        )
    )


def _first_entries(entries: Column, n: int) -> Column:
    return F.slice(F.array_sort(entries), 1, n)


def _check(n: int) -> None:
    if n < 1:
        raise ValueError("n must be at least 1")
