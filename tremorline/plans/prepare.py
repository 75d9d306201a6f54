"""Batch jobs that lay a feed out as files for a stream to read."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import event_time
from ..operators import keep_recent
from ..sources import MAX_RECORDS, feed_columns, read_raw, write_microfiles
from ..storage import list_dir, make_dir, read_text, rename, scratch_dir, write_text

# Rows of a range, which a stream takes as one batch.
RANGE_RECORDS = 1_000_000

# Tasks that write one range, at most.
MAX_PIECES = 8

_RANGE = "range"
_MANIFEST = "_ranges"


def prepare_microfiles(
    spark: SparkSession,
    raw: str,
    out: str,
    max_records: int = MAX_RECORDS,
    last_days: float = 0,
    now: datetime | None = None,
) -> None:
    """Raw feed files at ``raw`` cut into small feed files in ``out``.

    One pass without a shuffle. ``last_days`` keeps recent events only.
    """
    feed = feed_columns(read_raw(spark, raw))
    write_microfiles(keep_recent(feed, last_days, now), out, max_records)


def prepare_replay(
    feed: DataFrame,
    out: str,
    max_records: int = MAX_RECORDS,
    partitions: int | None = None,
    fixed_order: bool = False,
    range_records: int = RANGE_RECORDS,
    few_ranges: int | None = None,
) -> int:
    """Feed rows in folders by range of event time, to be delivered one after the other.

    ``out/range=<n>`` holds the files of a range, in time order; a list of the folders
    is written last. ``deliver_ranges`` hands them to a stream. Rows
    without a readable time come first. Returns how many ranges there are.

    The rows are sorted in ranges. A row number breaks ties, so the ranges can
    cut through a time that very many rows share, or through the rows without
    one. ``partitions`` fixes the number of ranges; otherwise they have about ``range_records``
    rows each. With ``few_ranges``, ranges of a feed that makes more are larger, up to
    ``RANGE_RECORDS`` rows: a batch costs a stream the same jobs and state commits whatever its rows.

    The row numbers must come out the same when a lost task is repeated, so the
    feed is first written to the shared folder. ``fixed_order`` says that its
    rows come in the same order each time they are read, as rows straight from
    files do, also after filters and projections; then it is read in place.
    """
    spark = feed.sparkSession
    order = ("_event_ts", "_tie")
    rows = feed_columns(feed)
    rows = rows if fixed_order else _stored(rows)
    if partitions is None:
        found = rows.count()
        if few_ranges is not None:
            largest = max(range_records, RANGE_RECORDS)
            range_records = min(largest, max(range_records, -(-found // few_ranges)))
        partitions = max(1, -(-found // range_records))
    keyed = rows.withColumns(
        {"_event_ts": event_time(F.col("time")), "_tie": F.monotonically_increasing_id()}
    )
    # Several tasks write a range that makes several files.
    pieces = min(MAX_PIECES, -(-range_records // max_records))
    number = F.floor(F.spark_partition_id() / pieces).cast("int")
    ranges = keyed.repartitionByRange(partitions * pieces, *order).withColumn(_RANGE, number)
    # The folder comes first in the order, so that the writer need not sort again.
    ranges = ranges.sortWithinPartitions(_RANGE, *order)
    write_microfiles(ranges.drop(*order), out, max_records, partition_by=(_RANGE,))
    names = [entry.name for entry in list_dir(spark, out) if entry.name.startswith(f"{_RANGE}=")]
    names.sort(key=_number)
    write_text(spark, f"{out}/{_MANIFEST}", "".join(f"{name}\n" for name in names))
    return len(names)


def deliver_ranges(
    spark: SparkSession,
    prepared: str,
    landing: str,
    queries: Sequence[StreamingQuery] = (),
    pause: float = 0,
    archive: str | None = None,
) -> int:
    """Move prepared ranges to ``landing`` in order; returns how many were moved.

    A range is one folder and one call, whatever the number of its files. Before the next one,
    ``queries``, which read ``landing/*``, have taken it, so their batches are in
    time order and their watermarks drop none; no file times are needed. ``pause``
    is the number of seconds after each range. A call that ended early is
    finished by the next one.

    With ``archive``, a folder outside ``landing``, a range goes on to there when all ``queries`` have
    taken it. A stream lists all of ``landing`` for every batch, so a replay of many ranges
    without it lists as many folders as there are ranges, time and again.
    """
    if archive is not None and not queries:
        raise ValueError("archive needs queries: they tell when a range has been taken")
    text = read_text(spark, f"{prepared}/{_MANIFEST}")
    if text is None:
        raise ValueError(f"{prepared} has no list of ranges; prepare_replay writes it last")
    make_dir(spark, landing)
    if archive is not None:
        make_dir(spark, archive)
    there = {entry.name for entry in list_dir(spark, prepared)}
    landed = {entry.name for entry in list_dir(spark, landing)}
    moved = 0
    for name in text.split():
        folder = f"{_number(name):09d}"
        if name in there:
            rename(spark, f"{prepared}/{name}", f"{landing}/{folder}")
            landed.add(folder)
            moved += 1
            time.sleep(pause)
        elif archive is not None and folder not in landed:
            continue
        # Also for one that an earlier call moved last.
        for query in queries:
            query.processAllAvailable()
        if archive is not None:
            rename(spark, f"{landing}/{folder}", f"{archive}/{folder}")
    return moved


def _number(name: str) -> int:
    return int(name.split("=")[1])


def _stored(feed: DataFrame) -> DataFrame:
    stored = f"{scratch_dir(feed.sparkSession, 'feed')}/rows"
    feed.write.parquet(stored)
    return feed.sparkSession.read.parquet(stored)
