"""What became of late events, batch by batch.

``late_report`` and ``LateRecorder`` give Spark's progress figures. ``late_groups_dropped`` counts rows
after the map-side count: late events of one window and group that one task
read together count once. It tells whether and when events were too late; how
many they were is at least this number. ``LateEvents`` keeps the events themselves, all of them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..operators import WINDOW, enrich
from ..schema import FEED_SCHEMA
from ..sources import read_feed
from . import batch_log, sinks, versions

REPORT_SCHEMA = StructType(
    [
        StructField("query_id", StringType(), True),
        StructField("batch_id", LongType(), True),
        StructField("input_rows", LongType(), True),
        StructField("watermark", TimestampType(), True),
        StructField("late_groups_dropped", LongType(), True),
        StructField("state_rows", LongType(), True),
    ]
)

LATE_SCHEMA = StructType(
    [
        StructField("window_start", TimestampType(), True),
        StructField("window_end", TimestampType(), True),
        *FEED_SCHEMA.fields,
        StructField(versions.BATCH, LongType(), True),
    ]
)


def late_report(spark: SparkSession, queries: Iterable[StreamingQuery]) -> DataFrame:
    """One row per recent batch of ``queries``.

    Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates``
    (100) batches of a query; record longer runs with ``LateRecorder``.
    """
    progress = [batch for query in queries for batch in query.recentProgress]
    return _frame(spark, map(_row, progress))


class LateRecorder(StreamingQueryListener):
    """Keeps the report of whole runs in a Parquet table at ``out``.

    Add it with ``spark.streams.addListener`` before the queries start. Spark
    calls it in the background, shortly after each batch. ``held`` rows wait in
    memory at most; then they are appended to the table.
    """

    def __init__(self, spark: SparkSession, out: str, held: int = 50) -> None:
        self._spark, self._out, self._held = spark, out, held
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self._rows.append(_row(event.progress))
            if len(self._rows) >= self._held:
                self._store()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def report(self) -> DataFrame:
        """All rows so far, from the table."""
        with self._lock:
            self._store()
        return self._spark.read.schema(REPORT_SCHEMA).parquet(self._out)

    def _store(self) -> None:
        _frame(self._spark, self._rows).coalesce(1).write.mode("append").parquet(self._out)
        self._rows = []


class LateEvents:
    """A writer that keeps the events which a query drops as too late, whole, in a table at ``out``.

    Give it to ``start`` or ``start_table`` beside others. The rows of a batch that come too late
    leave no trace in its result, so the batch's files, which the query's checkpoint names, are read
    again, and events kept whose window had closed in the batch before. A batch has its own
    folder and replaces it when it is repeated, so after a run of any length the table holds each
    dropped event once; with overlapping windows, once for each window that it missed.

    ``length`` and ``slide`` are those of the counts, ``events`` reads files (a list of paths) with
    the columns of the feed and ``event_ts``; it should read them as the query does.
    """

    takes_empty = True  # all events of a batch may be too late

    def __init__(
        self,
        out: str,
        length: str = WINDOW,
        slide: str | None = None,
        events: Callable[[SparkSession, Sequence[str]], DataFrame] | None = None,
    ) -> None:
        self._length, self._slide = length, slide
        self._events = events or (lambda spark, paths: enrich(read_feed(spark, paths)))
        self._write = sinks.versioned_table(out)
        self.versioned_out = out
        self.checkpoint: str | None = None  # set when the query starts

    def __call__(self, batch_df: DataFrame, batch_id: int, rows: int) -> None:
        spark = batch_df.sparkSession
        paths = batch_log.new_files(spark, self.checkpoint, batch_id)
        if not paths:
            return
        mark = batch_log.late_ms(spark, self.checkpoint, batch_id)
        windows = self._events(spark, paths).where("event_ts is not null").select(
            *FEED_SCHEMA.names, F.window("event_ts", self._length, self._slide).alias("window")
        )
        late = windows.where(F.unix_millis("window.end") <= F.lit(mark)).select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *FEED_SCHEMA.names,
        )
        late = late.persist()
        try:
            if dropped := late.count():
                self._write(late, batch_id, dropped)
        finally:
            late.unpersist()


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """The table of ``LateEvents``: ``batch_id``, the window missed, and the feed's columns."""
    return spark.read.schema(LATE_SCHEMA).parquet(out)


def _row(progress) -> tuple:
    watermark = progress.eventTime.get("watermark")
    # Groups dropped by a later operator of a chain were counted before.
    states = progress.stateOperators
    return (
        str(progress.id),
        progress.batchId,
        progress.numInputRows,
        _instant(watermark) if watermark else None,
        sum(state.numRowsDroppedByWatermark for state in states),
        sum(state.numRowsTotal for state in states),
    )


def _instant(text: str) -> datetime:
    return datetime.fromisoformat(text).astimezone(timezone.utc)


def _frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), REPORT_SCHEMA)
