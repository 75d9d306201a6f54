"""The streaming job: feed files in, counts per window and group out."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import DELAY, RESULT_KEYS, WINDOW, enrich, pane_counts, window_counts
from ..sources import stream_feed
from ..storage import make_dir, scratch_dir
from . import sinks

# Output modes by what the reader gets: each window once, after it has closed,
# or every change of a count.
MODES = {"final": "append", "changelog": "update"}

TABLES = {"versioned": sinks.versioned_table, "append": sinks.append_table}


def stream_events(spark: SparkSession, landing: str, **source) -> DataFrame:
    """Enriched events from a landing folder; ``source`` as in ``stream_feed``."""
    return enrich(stream_feed(spark, landing, **source))


def stream_counts(
    spark: SparkSession,
    landing: str,
    keys: Sequence[str] = RESULT_KEYS,
    length: str = WINDOW,
    slide: str | None = None,
    delay: str = DELAY,
    **source,
) -> DataFrame:
    """Counts per window and group, as a stream."""
    return window_counts(stream_events(spark, landing, **source), keys, length, slide, delay)


def start(
    results: DataFrame,
    *writers: sinks.Writer,
    mode: str = "final",
    checkpoint: str | None = None,
    until_caught_up: bool = False,
    every: str | None = None,
    state_partitions: int | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start one query that gives each batch of ``results`` to all ``writers``.

    With the same ``checkpoint`` a later start goes on where this one ended; a
    new one, or none, starts afresh. ``until_caught_up`` ends the query when
    the files that were there at the start are read. Otherwise batches follow
    each other without pause, or start ``every`` so often ("1 minute"), which
    keeps the number of output files down. ``state_partitions`` is the number
    of shuffle partitions; it is fixed by a checkpoint's first start.
    """
    spark = results.sparkSession
    # Spark's own choice, a temporary folder, may lie on one machine.
    checkpoint = checkpoint or scratch_dir(spark, "checkpoint")
    if mode != "final" and any(getattr(w, "whole_windows", False) for w in writers):
        raise ValueError('top tables need whole windows: use mode="final"')
    for writer in writers:
        if isinstance(writer, sinks.ClosedWindows) and mode != "changelog":
            raise ValueError('closed windows are taken from changes: use mode="changelog"')
        if hasattr(writer, "checkpoint"):
            writer.checkpoint = checkpoint
    sinks.refuse_foreign_batches(spark, writers, checkpoint)
    for folder in sinks.versioned_folders(writers):
        make_dir(spark, folder)
    writer = (
        results.writeStream.outputMode(MODES[mode])
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sinks.each_batch(*writers))
    )
    if name:
        writer = writer.queryName(name)
    if until_caught_up:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    with _shuffle_partitions(spark, state_partitions):
        query = writer.start()
    sinks.claim(spark, writers, str(query.id))
    return query


def start_table(
    results: DataFrame,
    out: str,
    checkpoint: str,
    *also: sinks.Writer,
    table: str = "versioned",
    partition_by: Sequence[str] = (),
    **options,
) -> StreamingQuery:
    """Start a query that keeps ``results`` in a Parquet table at ``out``.

    ``also`` are further writers fed from the same batches; ``options`` as in
    ``start``.
    """
    writer = TABLES[table](out, partition_by)
    make_dir(results.sparkSession, out)
    return start(results, writer, *also, checkpoint=checkpoint, **options)


def start_sliding(
    events: DataFrame,
    out: str,
    checkpoint: str,
    length: str,
    slide: str,
    keys: Sequence[str] = RESULT_KEYS,
    delay: str = DELAY,
    partition_by: Sequence[str] = (),
    **options,
) -> StreamingQuery:
    """Start a query that keeps closed overlapping windows in a versioned table at ``out``.

    ``slide`` divides ``length``. The state has one row per pane and group, not one per window;
    the rows are those of ``window_counts`` in final mode. ``options`` as in ``start``.
    """
    panes = pane_counts(events, keys, length, slide, delay)
    table = sinks.versioned_table(out, partition_by)
    closing = sinks.ClosedSlidingWindows(table, out, length, slide)
    return start(panes, closing, mode="changelog", checkpoint=checkpoint, **options)


def start_console(
    results: DataFrame, rows_shown: int = 20, out: TextIO | None = None, **options
) -> StreamingQuery:
    """Start a query that prints the changed counts of each batch."""
    return start(results, sinks.console(rows_shown, out), **{"mode": "changelog", **options})


def build_stream(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    table: str = "versioned",
    mode: str = "final",
    partition_by: Sequence[str] = (),
    console_out: TextIO | None = None,
    until_caught_up: bool = False,
    every: str | None = None,
    state_partitions: int | None = None,
    **counts,
) -> list[StreamingQuery]:
    """Start the standard job; returns ``[console query, table query]``.

    The console shows changes. The table keeps them, too, with
    ``mode="changelog"``, or with ``mode="final"`` each window once it has closed. Either way one
    query reads and counts for both and is returned twice. ``counts`` as in
    ``stream_counts``.
    """
    results = stream_counts(spark, landing, **counts)
    writer = TABLES[table](out, partition_by)
    if MODES[mode] == "append":
        writer = sinks.ClosedWindows(writer, out)
    make_dir(spark, out)
    both = start(
        results,
        sinks.console(out=console_out),
        writer,
        checkpoint=checkpoint,
        mode="changelog",
        until_caught_up=until_caught_up,
        every=every,
        state_partitions=state_partitions,
    )
    return [both, both]


def wait_for_all(queries: Sequence[StreamingQuery], poll_seconds: float = 0.5) -> None:
    """Wait until all queries have ended, or stop them on a keyboard interrupt.

    If one fails, the others are stopped and its error is raised here,
    whichever query it came from.
    """
    try:
        pending = list(queries)
        while pending:
            # A failed query raises its error here.
            pending = [query for query in pending if not query.awaitTermination(poll_seconds)]
    except KeyboardInterrupt:
        pass
    finally:
        for query in queries:
            if query.isActive:
                query.stop()


@contextmanager
def _shuffle_partitions(spark: SparkSession, number: int | None):
    """A query copies the session's settings when it starts."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        if number is not None:
            spark.conf.set(key, number)
        yield
    finally:
        spark.conf.set(key, before)
